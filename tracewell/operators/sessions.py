"""Sessions: traces from recorded events, with attribution of recalled skills and outcomes by checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.messages import short


def passed(flag: Column, code: Column) -> Column:
    """Whether a check passed: its boolean if it has one, else whether its exit code is 0; null without either."""
    return F.coalesce(flag, code == 0)


def build(events: DataFrame) -> DataFrame:
    """(session, task, agent, steps, signals, skills_used, bullets_helpful, bullets_harmful): a trace of each session.

    ``events``: session, seq, kind, agent, name, text, args, result, error, flag BOOLEAN, code INT, confidence, bullets.
    Kinds: task (its text is the task and the first step), tool (a call), say, observe, raise (a call that failed, and a
    failure), recall (a skill shown; it counts once), ok, fail, partial, verify (outcome by flag or exit code, from source
    'test'), used and misled (bullets). The last outcome counts; a session without one has no signal. Events of a null
    session or kind are left out; unknown kinds do nothing. Rows are gathered by session in order of seq: a session's own.
    """
    null = F.lit(None).cast("string")
    kind = F.col("kind")
    call = F.struct(F.coalesce("name", F.lit("?")).alias("name"), F.coalesce("args", F.lit("{}")).alias("args"), "result", F.when(kind == "raise", F.coalesce("error", F.lit("exception"))).otherwise(F.col("error")).alias("error"), F.lit(None).cast("int").alias("duration_ms"))
    role = F.when(kind == "task", "user").when(kind == "observe", "tool").when(kind.isin("say", "tool", "raise"), "assistant")
    calls = F.when(kind.isin("tool", "raise"), F.array(call)).otherwise(F.array().cast("array<struct<name:string,args:string,result:string,error:string,duration_ms:int>>"))
    verdict = passed(F.col("flag"), F.col("code"))
    outcome = F.when(kind == "ok", "success").when(kind.isin("fail", "raise"), "failure").when(kind == "partial", "partial").when(kind == "verify", F.when(verdict, "success").when(~verdict, "failure"))
    source = F.when(kind == "verify", "test").when(outcome.isNotNull(), "session")
    detail = F.when(kind == "verify", F.coalesce(F.nullif("text", F.lit("")), F.when(verdict, "checker passed").otherwise("checker failed"))).otherwise(F.coalesce("text", F.lit("")))
    sure = F.coalesce("confidence", F.when(kind == "partial", 0.8).otherwise(0.9))
    d = events.where(F.col("session").isNotNull() & kind.isNotNull()).select(
        "session", "seq", "agent", kind.alias("kind"), "bullets",
        F.when(role.isNotNull(), F.struct(role.alias("role"), F.coalesce("text", F.lit("")).alias("content"), calls.alias("tool_calls"))).alias("step"),
        F.when(outcome.isNotNull(), F.struct(source.alias("source"), outcome.alias("outcome"), sure.alias("confidence"), F.left(detail, F.lit(300)).alias("detail"))).alias("signal"),
        F.when(kind == "task", F.col("text")).otherwise(null).alias("task"), F.when(kind == "recall", F.col("name")).otherwise(null).alias("skill"),
    )
    g = d.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("seq", "kind", "step", "signal", "skill", "bullets"))).alias("e"), F.min_by("task", F.when(F.col("task").isNotNull(), F.col("seq"))).alias("task"), F.max("agent").alias("agent"))
    kept = lambda f: F.filter(F.transform("e", lambda x: x[f]), lambda y: y.isNotNull())
    last = F.try_element_at(kept("signal"), F.lit(-1))
    of = lambda k: F.flatten(F.filter(F.transform("e", lambda x: F.when(x["kind"] == k, x["bullets"])), lambda y: y.isNotNull()))
    return g.select("session", "task", "agent", kept("step").alias("steps"), F.when(last.isNotNull(), F.array(last)).otherwise(F.slice(kept("signal"), 1, 0)).alias("signals"), F.array_distinct(kept("skill")).alias("skills_used"), of("used").alias("bullets_helpful"), of("misled").alias("bullets_harmful"))


def attribute(shown: DataFrame) -> DataFrame:
    """(session, skills): names shown in a session, each once, in order of their first showing; '_principles' is none.
    ``shown``: session, seq, name."""
    first = shown.where(F.col("session").isNotNull() & F.col("name").isNotNull() & (F.col("name") != "_principles")).groupBy("session", "name").agg(F.min("seq").alias("seq"))
    return first.groupBy("session").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "name"))), lambda x: x["name"]).alias("skills"))


def checked(runs: DataFrame) -> DataFrame:
    """``runs`` (task, exit_code, recheck_code, harness_error) with status, rechecked and passed: a run that ended by time (3
    or 124) counts by its second check; a run with a harness error doesn't pass."""
    late = F.col("exit_code").isin(3, 124)
    code = F.when(late, F.coalesce("recheck_code", "exit_code")).otherwise(F.col("exit_code"))
    status = F.when(code == 0, "pass").when(code.isin(3, 124), "timeout").otherwise("fail")
    return runs.withColumns({"rechecked": F.coalesce(late, F.lit(False)), "status": status, "passed": F.coalesce(code == 0, F.lit(False)) & F.col("harness_error").isNull()})


def evaluations(traces: DataFrame) -> DataFrame:
    """(id, skill, status, trace_id): evaluations that runs report: of each eval_id the newest run decides; passed is a
    success of confidence 0.5 or more. ``traces``: id, ts, eval_id, skills_used, outcome, confidence."""
    w = Window.partitionBy("eval_id").orderBy(F.desc_nulls_last("ts"), "id")
    d = traces.where(F.col("eval_id").isNotNull()).withColumn("n", F.row_number().over(w)).where("n = 1")
    ok = (F.col("outcome") == "success") & (F.col("confidence") >= 0.5)
    return d.select(F.col("eval_id").alias("id"), F.try_element_at("skills_used", F.lit(1)).alias("skill"), F.when(ok, "passed").otherwise("failed").alias("status"), F.col("id").alias("trace_id"))


def run_evaluations(pending: DataFrame, results: DataFrame) -> DataFrame:
    """Pending evaluations (id, skill, task) with the outcome of their runs (id, ok, error): a run that crashed, and one
    that isn't there, failed."""
    d = pending.join(results.select("id", "ok", F.col("error").alias("_error")), "id", "left")
    ok = F.coalesce("ok", F.lit(False)) & F.col("_error").isNull()
    return d.select(*pending.columns, F.when(ok, "success").otherwise("failure").alias("outcome"), short(F.coalesce("_error", F.when(F.col("ok").isNull(), "no run").otherwise("")), 300).alias("detail"))


def overrides(skills: DataFrame, commands: DataFrame) -> DataFrame:
    """``skills`` (name, status, successes, cleared, approved) after manual ``commands`` (name, seq, action, status).

    'status' sets the status; 'approve' approves and clears, and makes a candidate with a success active. They act in order
    of seq, so a status after an approval stands. Commands on unknown names do nothing.
    """
    todo = commands.where(F.col("name").isNotNull()).groupBy("name").agg(F.sort_array(F.collect_list(F.struct(F.col("seq").cast("bigint").alias("seq"), "action", F.col("status").alias("to")))).alias("_todo"))
    d = skills.join(todo, "name", "left")
    state = "struct<status:string,yes:boolean>"
    start = F.struct(F.col("status").alias("status"), F.lit(False).alias("yes")).cast(state)

    def one(s: Column, c: Column) -> Column:
        approve = F.coalesce(c["action"] == "approve", F.lit(False))
        live = approve & (s["status"] == "candidate") & (F.coalesce("successes", F.lit(0)) >= 1)
        return F.struct(F.when(live, "active").when((c["action"] == "status") & c["to"].isNotNull(), c["to"]).otherwise(s["status"]).alias("status"), (s["yes"] | approve).alias("yes")).cast(state)

    d = d.withColumn("_s", F.aggregate(F.coalesce("_todo", F.array().cast("array<struct<seq:bigint,action:string,to:string>>")), start, one))
    yes = F.col("_s.yes")
    return d.withColumns({"status": F.col("_s.status"), "cleared": yes | F.coalesce("cleared", F.lit(False)), "approved": yes | F.coalesce("approved", F.lit(False))}).select(*skills.columns)
