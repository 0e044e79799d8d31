"""Messages of chat formats to steps, within a row: no shuffle, and null or odd messages don't fail.

A message is (role, content, blocks, tool_calls, tool_call_id, is_error): ``content`` is text, ``blocks`` are content blocks
(type, text, id, name, input, tool_use_id, content, is_error) where the content was a list, ``tool_calls`` are (id, name,
arguments). Steps are those of the traces: (role, content, tool_calls (name, args, result, error, duration_ms)).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.safety import once
from tracewell.functions.text import error_sniff

BLOCK = "struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean>"
CALL = "struct<id:string,name:string,arguments:string>"
MESSAGE = f"struct<role:string,content:string,blocks:array<{BLOCK}>,tool_calls:array<{CALL}>,tool_call_id:string,is_error:boolean>"
STEP_CALL = "struct<name:string,args:string,result:string,error:string,duration_ms:int>"
STEP = f"struct<role:string,content:string,tool_calls:array<{STEP_CALL}>>"
SIGNAL = "struct<source:string,outcome:string,confidence:double,detail:string>"
#: What a payload may hold; messages and steps are read with these types.
PAYLOAD = (
    f"struct<task:string,format:string,agent:string,id:string,ts:double,eval_id:string,metadata:string,skills_used:array<string>,bullets_helpful:array<string>,bullets_harmful:array<string>,"
    f"messages:array<{MESSAGE}>,steps:array<{STEP}>,signals:array<{SIGNAL}>>"
)


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def text_of(m: Column) -> Column:
    """The text of a message: its content, or the text blocks, a line each; null is empty."""
    texts = F.transform(F.filter(F.coalesce(m["blocks"], _none(BLOCK)), lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit("")))
    return F.when(m["blocks"].isNotNull(), F.array_join(texts, "\n")).otherwise(F.coalesce(m["content"], F.lit("")))


def arguments(a: Column) -> Column:
    """Arguments as JSON: empty ones as {}, text that doesn't parse as {"raw": text}."""
    return F.when(F.coalesce(a, F.lit("")) == "", "{}").when(F.try_parse_json(a).isNotNull(), a).otherwise(F.to_json(F.struct(a.alias("raw"))))


def _step(role: Column, content: Column, calls: Column) -> Column:
    return F.struct(role.alias("role"), content.alias("content"), calls.alias("tool_calls"))


def _answers(asked: Column, told: Column, i: Column, n: Column, id: Column) -> Column:
    """Of the answers (at, id, text, bad) to ``id``, the last result and the last error among those that come after the call
    at (i, n) and before the next call of that id; ``asked`` are the calls (at, n, id)."""
    later = F.filter(asked, lambda c: (c["id"] == id) & ((c["at"] > i) | ((c["at"] == i) & (c["n"] > n))))
    until = F.array_min(F.transform(later, lambda c: c["at"]))
    return F.filter(told, lambda t: (t["id"] == id) & (t["at"] > i) & (until.isNull() | (t["at"] <= until)))


def _answered(name: Column, args: Column, hits: Column) -> Column:
    last = lambda bad: F.try_element_at(F.filter(hits, lambda t: t["bad"] if bad else ~t["bad"]), F.lit(-1))["text"]
    return F.struct(F.coalesce(name, F.lit("?")).alias("name"), args.alias("args"), last(False).alias("result"), last(True).alias("error"), F.lit(None).cast("int").alias("duration_ms"))


def openai_steps(messages: Column) -> Column:
    """Steps of messages with calls in assistant turns and answers in turns of role tool.

    An answer belongs to the latest call of its id before it, and is an error if it says so or looks like one; an answer
    without a call becomes a step of its own. Arguments that don't parse are kept as {"raw": text}. Null messages are left out.
    """
    ms = F.filter(F.coalesce(messages, _none(MESSAGE)), lambda m: m.isNotNull())
    role = lambda m: F.coalesce(m["role"], F.lit("assistant"))
    calls = lambda m: F.coalesce(m["tool_calls"], _none(CALL))
    asked = F.flatten(F.transform(ms, lambda m, i: F.transform(F.when(role(m) == "assistant", calls(m)).otherwise(_none(CALL)), lambda c, n: F.struct(i.alias("at"), n.alias("n"), c["id"].alias("id")))))
    told = F.filter(F.transform(ms, lambda m, i: F.struct(i.alias("at"), F.coalesce(m["tool_call_id"], F.lit("")).alias("id"), text_of(m).alias("text"), (error_sniff(text_of(m)) | F.coalesce(m["is_error"], F.lit(False))).alias("bad"), (role(m) == "tool").alias("tool"))), lambda t: t["tool"])

    def one(z: Column, m: Column, i: Column) -> Column:
        own = F.transform(calls(m), lambda c, n: once(_answers(z["asked"], z["told"], i, n, c["id"]), lambda hits: _answered(c["name"], arguments(c["arguments"]), hits)))
        orphan = ~F.exists(z["asked"], lambda c: (c["id"] == F.coalesce(m["tool_call_id"], F.lit(""))) & (c["at"] < i))
        return (
            F.when(role(m) == "assistant", _step(role(m), text_of(m), own))
            .when((role(m) != "tool") | orphan, _step(role(m), text_of(m), _none(STEP_CALL)))
        )

    z = F.struct(ms.alias("ms"), asked.alias("asked"), told.alias("told"))
    return once(z, lambda z: F.filter(F.transform(z["ms"], lambda m, i: one(z, m, i)), lambda s: s.isNotNull()))


def anthropic_steps(messages: Column) -> Column:
    """Steps of messages with tool_use blocks in assistant turns and tool_result blocks in user turns.

    A result belongs to the latest use of its id before it; one without is dropped; a turn with results makes no step.
    """
    ms = F.filter(F.coalesce(messages, _none(MESSAGE)), lambda m: m.isNotNull())
    role = lambda m: F.coalesce(m["role"], F.lit("assistant"))
    of = lambda m, kind: F.filter(F.coalesce(m["blocks"], _none(BLOCK)), lambda b: b["type"] == kind)
    asked = F.flatten(F.transform(ms, lambda m, i: F.transform(F.when(role(m) == "assistant", of(m, "tool_use")).otherwise(_none(BLOCK)), lambda b, n: F.struct(i.alias("at"), n.alias("n"), b["id"].alias("id")))))
    result = lambda b, i: F.struct(i.alias("at"), F.coalesce(b["tool_use_id"], F.lit("")).alias("id"), F.coalesce(b["content"], F.lit("")).alias("text"), (F.coalesce(b["is_error"], F.lit(False)) | error_sniff(b["content"])).alias("bad"))
    told = F.flatten(F.transform(ms, lambda m, i: F.transform(F.when(role(m) == "user", of(m, "tool_result")).otherwise(_none(BLOCK)), lambda b: result(b, i))))

    def one(z: Column, m: Column, i: Column) -> Column:
        own = F.transform(of(m, "tool_use"), lambda b, n: once(_answers(z["asked"], z["told"], i, n, b["id"]), lambda hits: _answered(b["name"], F.coalesce(F.nullif(b["input"], F.lit("")), F.lit("{}")), hits)))
        answers = (role(m) == "user") & (F.size(of(m, "tool_result")) > 0)
        return F.when(role(m) == "assistant", _step(role(m), text_of(m), own)).when(~answers, _step(role(m), text_of(m), _none(STEP_CALL)))

    z = F.struct(ms.alias("ms"), asked.alias("asked"), told.alias("told"))
    return once(z, lambda z: F.filter(F.transform(z["ms"], lambda m, i: one(z, m, i)), lambda s: s.isNotNull()))


def canonical_steps(steps: Column) -> Column:
    """Steps with defaults: role assistant, empty content, no calls; null steps are left out."""
    kept = F.filter(F.coalesce(steps, _none(STEP)), lambda s: s.isNotNull())
    return F.transform(kept, lambda s: _step(F.coalesce(s["role"], F.lit("assistant")), F.coalesce(s["content"], F.lit("")), F.filter(F.coalesce(s["tool_calls"], _none(STEP_CALL)), lambda c: c.isNotNull())))


def format_of(p: Column) -> Column:
    """The format of a payload: what it names, if it has messages; else openai with a message of role tool, anthropic with
    other messages; canonical with steps."""
    guess = F.when(F.exists(p["messages"], lambda m: F.coalesce(m["role"] == "tool", F.lit(False))), "openai").otherwise("anthropic")
    named = p["format"].isin("openai", "anthropic") & p["messages"].isNotNull()
    return F.when(F.coalesce(named, F.lit(False)), p["format"]).when(p["messages"].isNotNull() & p["steps"].isNull(), guess).otherwise("canonical")


def normalise(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """``payloads`` (a JSON text in ``column``) with columns of a trace, ``format`` and ``problem``.

    A text that isn't an object, a payload without a task, or without steps and messages has a problem and null columns;
    rows are never dropped. Feedback on bullets and signals are carried over in every format.
    """
    d = payloads.withColumn("_p", F.from_json(column, PAYLOAD))
    p, ok = F.col("_p"), F.try_parse_json(column).isNotNull() & F.ltrim(column).startswith("{")
    problem = (
        F.when(~F.coalesce(ok, F.lit(False)), "not an object")
        .when(p["task"].isNull(), "no task")
        .when(p["steps"].isNull() & p["messages"].isNull(), "no steps or messages")
    )
    d = d.withColumn("problem", problem).withColumn("format", F.when(F.col("problem").isNull(), format_of(p)))
    steps = F.when(F.col("format") == "openai", openai_steps(p["messages"])).when(F.col("format") == "anthropic", anthropic_steps(p["messages"])).when(F.col("format") == "canonical", canonical_steps(p["steps"]))
    keep = {c: F.when(F.col("problem").isNull(), p[c]) for c in ("task", "id", "ts", "eval_id", "metadata", "skills_used", "bullets_helpful", "bullets_harmful", "signals")}
    return d.withColumns({**keep, "agent": F.when(F.col("problem").isNull(), F.coalesce(p["agent"], F.lit("unknown"))), "steps": steps}).drop("_p")


def to_openai(steps: Column) -> Column:
    """Steps as messages: each with its calls, each call followed by a message of role tool with its error or result."""
    s_of = F.filter(F.coalesce(steps, _none(STEP)), lambda s: s.isNotNull())

    def one(s: Column, i: Column) -> Column:
        calls = F.filter(F.coalesce(s["tool_calls"], _none(STEP_CALL)), lambda c: c.isNotNull())
        key = lambda n: F.concat(F.lit("c"), i.cast("string"), F.lit("-"), n.cast("string"))
        head = F.struct(F.when(F.size(calls) > 0, "assistant").otherwise(s["role"]).alias("role"), s["content"].alias("content"), F.lit(None).cast(f"array<{BLOCK}>").alias("blocks"), F.transform(calls, lambda c, n: F.struct(key(n).alias("id"), c["name"].alias("name"), c["args"].alias("arguments"))).alias("tool_calls"), F.lit(None).cast("string").alias("tool_call_id"), F.lit(None).cast("boolean").alias("is_error"))
        answer = lambda c, n: F.when(F.coalesce(c["error"], c["result"]).isNotNull(), F.struct(F.lit("tool").alias("role"), F.coalesce(c["error"], c["result"]).alias("content"), F.lit(None).cast(f"array<{BLOCK}>").alias("blocks"), F.lit(None).cast(f"array<{CALL}>").alias("tool_calls"), key(n).alias("tool_call_id"), c["error"].isNotNull().alias("is_error")))
        return F.concat(F.array(head), F.filter(F.transform(calls, answer), lambda m: m.isNotNull()))

    return F.flatten(F.transform(s_of, one))


def to_anthropic(steps: Column) -> Column:
    """Steps as messages with blocks: text and tool_use of a step, then its answers as tool_result blocks of one user turn."""
    s_of = F.filter(F.coalesce(steps, _none(STEP)), lambda s: s.isNotNull())
    null = lambda kind="string": F.lit(None).cast(kind)

    def block(**set: Column) -> Column:
        kinds = {"type": "string", "text": "string", "id": "string", "name": "string", "input": "string", "tool_use_id": "string", "content": "string", "is_error": "boolean"}
        return F.struct(*(set.get(k, null(t)).cast(t).alias(k) for k, t in kinds.items()))

    def message(role: Column, blocks: Column) -> Column:
        return F.struct(role.alias("role"), null().alias("content"), blocks.alias("blocks"), null(f"array<{CALL}>").alias("tool_calls"), null().alias("tool_call_id"), null("boolean").alias("is_error"))

    def one(s: Column, i: Column) -> Column:
        calls = F.filter(F.coalesce(s["tool_calls"], _none(STEP_CALL)), lambda c: c.isNotNull())
        key = lambda n: F.concat(F.lit("c"), i.cast("string"), F.lit("-"), n.cast("string"))
        uses = F.transform(calls, lambda c, n: block(type=F.lit("tool_use"), id=key(n), name=c["name"], input=c["args"]))
        head = message(F.when(F.size(calls) > 0, "assistant").otherwise(s["role"]), F.concat(F.array(block(type=F.lit("text"), text=s["content"])), uses))
        told = F.filter(F.transform(calls, lambda c, n: F.when(F.coalesce(c["error"], c["result"]).isNotNull(), block(type=F.lit("tool_result"), tool_use_id=key(n), content=F.coalesce(c["error"], c["result"]), is_error=c["error"].isNotNull()))), lambda b: b.isNotNull())
        return F.when(F.size(told) > 0, F.array(head, message(F.lit("user"), told))).otherwise(F.array(head))

    return F.flatten(F.transform(s_of, one))
