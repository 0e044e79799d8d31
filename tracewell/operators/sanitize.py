"""Sanitising of traces before they are kept: redaction and caps, field by field and over the whole."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from tracewell.functions import safety
from tracewell.operators.normalise import STEP

MAX_TOTAL = 200_000
_RULES = [(re.compile(p), {"": "", "1": r"\1", "12": r"\1"}[g] + f"[REDACTED:{k}]" + (r"\2" if g == "12" else "")) for k, p, g in safety.REDACTIONS]


def redact_json(value, count: list[int] | None = None):
    """A parsed JSON value with the secrets of all its strings replaced, keys left alone."""
    if isinstance(value, dict):
        return {k: redact_json(v, count) for k, v in value.items()}
    if isinstance(value, list):
        return [redact_json(v, count) for v in value]
    if isinstance(value, str):
        for pattern, new in _RULES:
            value, n = pattern.subn(new, value)
            if count is not None:
                count[0] += n
    return value


def clean_args(text: str | None, most: int = safety.MAX_ARGS) -> tuple[str | None, int, int]:
    """(arguments, secrets, 1 if cut) of a JSON text: its strings redacted, as JSON again; beyond ``most`` characters an
    object with what is left of the text. A text that isn't JSON is redacted as one string."""
    if not text:
        return text, 0, 0
    count = [0]
    try:
        value = json.loads(text)
    except ValueError:
        out = redact_json(text, count)
    else:
        clean = redact_json(value, count)
        out = json.dumps(clean, ensure_ascii=False) if count[0] else text
    if len(out) > most:
        return json.dumps({"_truncated": out[:most]}, ensure_ascii=False), count[0], 1
    return out, count[0], 0


@F.pandas_udf(ArrayType(ArrayType(StructType().add("args", "string").add("found", "integer").add("cut", "integer"))))
def _clean_args(steps: pd.Series) -> pd.Series:
    one = lambda t: dict(zip(("args", "found", "cut"), clean_args(t), strict=True))
    return steps.map(lambda s: None if s is None else [None if c is None else [one(t) for t in c] for c in s])


def _clip(text: str | None, most: int) -> str | None:
    return text[:most] + safety.MARK if text and len(text) > most else text


def fit(task: str, steps: list[dict], rest: int, most: int) -> tuple[str, list[dict], int]:
    """(task, steps, steps dropped) whose JSON, with ``rest`` characters of other fields, is at most ``most`` long.

    The middle half of the steps goes, again and again, down to two; then the texts of those are clipped to equal shares of
    the room, then answers and arguments dropped, then one step says that the body is gone.
    """
    size = lambda t, s: rest + len(json.dumps(t, ensure_ascii=False)) + len(json.dumps(s, ensure_ascii=False))
    had = len(steps)
    while len(steps) > 2 and size(task, steps) > most:
        keep = max(2, len(steps) // 2)
        steps = steps[: keep // 2] + steps[len(steps) - (keep - keep // 2) :]
    dropped = had - len(steps)
    if size(task, steps) <= most:
        return task, steps, dropped
    room = max(200, most // max(1, len(steps)) // 2)
    short = lambda c: {**c, "result": _clip(c["result"], room), "error": _clip(c["error"], room), "args": c["args"] if len(c["args"] or "") <= room else json.dumps({"_truncated": c["args"][:room]}, ensure_ascii=False)}
    each = lambda s, f: {**s, "tool_calls": None if s["tool_calls"] is None else [c and f(c) for c in s["tool_calls"]]}
    steps = [{**each(s, short), "content": _clip(s["content"], room)} for s in steps if s]
    if size(task, steps) > most:
        steps = [each(s, lambda c: {**c, "args": "{}", "result": None, "error": "[dropped]"}) for s in steps]
    if size(task, steps) > most:
        task, steps, dropped = (task or "")[:1000], [{"role": "system", "content": "[trace exceeded size cap; body dropped by sanitizer]", "tool_calls": []}], had
    return task, steps, dropped


@F.pandas_udf(StructType().add("task", "string").add("steps", "string").add("dropped", "integer"))
def _fit(task: pd.Series, steps: pd.Series, rest: pd.Series, most: pd.Series) -> pd.DataFrame:
    rows = []
    for t, s, r, m in zip(task, steps, rest, most, strict=True):
        if s is None:  # within the size
            rows.append((None, None, None))
        else:
            t, s, n = fit(t, [{"role": None, "content": None, "tool_calls": None, **x, **({"tool_calls": [c and {"name": None, "args": None, "result": None, "error": None, "duration_ms": None, **c} for c in x["tool_calls"]]} if x.get("tool_calls") is not None else {})} for x in json.loads(s) if x], int(r), int(m))
            rows.append((t, json.dumps(s, ensure_ascii=False), n))
    return pd.DataFrame(rows, columns=["task", "steps", "dropped"])


def sanitize(traces: DataFrame, most: int = MAX_TOTAL) -> DataFrame:
    """``traces`` with redacted and capped task and steps, and columns redacted, truncated and steps_dropped (counts).

    Of more than 400 steps the first and last 200 stay; contents, results and errors are capped with a mark; arguments are
    walked as JSON, so what is left of them is JSON. Then the JSON of the whole trace is at most ``most`` characters long.
    Texts are redacted once, in the JVM; only arguments, and the steps of traces that are still too large, go through
    Python. Null fields stay null; an empty table gives an empty result. ``traces`` needs task and steps.
    """
    others = [c for c in traces.columns if c not in ("task", "steps")]
    # Marked as not repeatable, the functions in Python are neither copied into later expressions nor run twice.
    first = traces.withColumns({"_steps": safety.cap_steps(F.col("steps")), "_had": F.coalesce(F.array_size("steps"), F.lit(0))})
    d = first.withColumn("_args", _clean_args.asNondeterministic()(F.transform("_steps", lambda s: F.transform(s["tool_calls"], lambda c: c["args"]))))
    field = safety.redact_capped

    def call(c: Column, a: Column) -> Column:
        result, error = field(c["result"], safety.MAX_RESULT), field(c["error"], safety.MAX_RESULT)
        return F.when(c.isNotNull(), F.struct(c["name"].alias("name"), a.alias("args"), result.alias("result"), error.alias("error"), c["duration_ms"].alias("duration_ms")))

    def step(s: Column, i: Column) -> Column:
        args = F.try_element_at("_args", i + 1)
        return F.when(s.isNotNull(), F.struct(s["role"].alias("role"), field(s["content"], safety.MAX_CONTENT).alias("content"), F.transform(s["tool_calls"], lambda c, n: call(c, F.try_element_at(args, n + 1))).alias("calls")))

    zero = lambda c: F.coalesce(c, F.lit(0))
    d = d.withColumns({"_done": F.transform("_steps", step), "_t": safety.redact_capped(F.col("task"), 1 << 30)})
    total = lambda f: zero(F.aggregate("_done", F.lit(0), lambda a, s: a + zero(f(s["content"])) + zero(F.aggregate(s["calls"], F.lit(0), lambda b, c: b + zero(f(c["result"])) + zero(f(c["error"]))))))
    of_args = lambda k: zero(F.aggregate(F.flatten("_args"), F.lit(0), lambda a, x: a + zero(x[k])))
    plain = F.transform("_done", lambda s: F.when(s.isNotNull(), F.struct(s["role"].alias("role"), s["content"]["t"].alias("content"), F.transform(s["calls"], lambda c: F.when(c.isNotNull(), F.struct(c["name"].alias("name"), c["args"]["args"].alias("args"), c["result"]["t"].alias("result"), c["error"]["t"].alias("error"), c["duration_ms"].alias("duration_ms")))).alias("tool_calls"))))
    d = d.withColumns({"steps": plain, "redacted": total(lambda x: x["n"]) + of_args("found") + zero(F.col("_t.n")), "truncated": total(lambda x: x["cut"]) + of_args("cut"), "_gone": F.col("_had") - zero(F.array_size("_steps"))})
    rest = F.length(F.to_json(F.struct(*others))) if others else F.lit(2)
    large = rest + F.length(F.coalesce("_t.t", F.lit(""))) + F.length(F.coalesce(F.to_json("steps"), F.lit(""))) + 40 > most
    d = d.withColumn("_fit", _fit.asNondeterministic()(F.when(large, F.coalesce("_t.t", F.lit(""))), F.when(large, F.to_json("steps")), F.when(large, rest + 40), F.lit(most)))
    fitted = F.col("_fit.steps").isNotNull()
    out = d.withColumns({"task": F.when(fitted, F.col("_fit.task")).otherwise(F.col("_t.t")), "steps": F.when(fitted, F.from_json("_fit.steps", f"array<{STEP}>")).otherwise(F.col("steps")), "steps_dropped": F.col("_gone") + zero(F.col("_fit.dropped"))})
    return out.select(*traces.columns, "redacted", "truncated", "steps_dropped")


def redacted_texts(traces: DataFrame) -> DataFrame:
    """(id, step_pos, call_pos, field, digest, found): tasks, contents, results and errors with a secret, by the digest of
    what is left; positions are -1 where a text has none. Texts are redacted where they lie; only digests are shuffled."""
    part = lambda at, field, t: F.struct(at.cast("int").alias("call_pos"), F.lit(field).alias("field"), t.alias("t"))
    calls = lambda s: F.coalesce(F.flatten(F.transform(s["tool_calls"], lambda c, i: F.array(part(i, "result", c["result"]), part(i, "error", c["error"])))), F.array().cast("array<struct<call_pos:int,field:string,t:string>>"))
    own = F.transform("steps", lambda s, i: F.transform(F.concat(F.array(part(F.lit(-1), "content", s["content"])), calls(s)), lambda x: F.struct(i.cast("int").alias("step_pos"), x["call_pos"].alias("call_pos"), x["field"].alias("field"), x["t"].alias("t"))))
    task = F.array(F.struct(F.lit(-1).alias("step_pos"), F.lit(-1).alias("call_pos"), F.lit("task").alias("field"), F.col("task").alias("t")))
    every = F.concat(task, F.coalesce(F.flatten(own), F.slice(task, 1, 0)))
    d = traces.where(F.col("id").isNotNull()).select("id", F.inline(F.filter(every, lambda x: x["t"] != "")))
    r = safety.redact_capped(F.col("t"), 1 << 30)
    return d.select("id", "step_pos", "call_pos", "field", safety.once(r, lambda x: F.struct(F.md5(x["t"]).alias("digest"), x["n"].alias("found"))).alias("r")).where("r.found > 0").select("id", "step_pos", "call_pos", "field", "r.digest", "r.found").distinct()
