"""Derivations from traces: latest delivery, calls, outcomes, signals, renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def n_calls(calls: Column) -> Column:
    """Tool calls of all steps, from ``steps.tool_calls``, so that contents aren't read; null steps or calls count as none."""
    return F.aggregate(calls, F.lit(0), lambda a, c: a + F.coalesce(F.array_size(c), F.lit(0)))


def n_errors(calls: Column) -> Column:
    """Tool calls with an error, from ``steps.tool_calls``; an empty error is none."""
    failed = lambda c: F.coalesce(F.array_size(F.filter(c, lambda x: F.coalesce(x["error"] != "", F.lit(False)))), F.lit(0))
    return F.aggregate(calls, F.lit(0), lambda a, c: a + failed(c))


def slim(traces: DataFrame) -> DataFrame:
    """A narrow row per trace, from its latest delivery (ties: the one with more signals).

    (id, agent, ts, received, eval_id, skills_used, calls, errors, signals). Null ids are left out. Steps are counted
    where they lie; only the narrow row is shuffled.
    """
    rows = traces.where(F.col("id").isNotNull()).select(
        "id", "agent", "ts", "received", "eval_id", "skills_used", F.coalesce(n_calls(F.col("steps.tool_calls")), F.lit(0)).alias("calls"), F.coalesce(n_errors(F.col("steps.tool_calls")), F.lit(0)).alias("errors"), "signals"
    )
    latest = Window.partitionBy("id").orderBy(F.col("received").desc_nulls_last(), F.desc(F.coalesce(F.array_size("signals"), F.lit(0))))
    return rows.withColumn("nth", F.row_number().over(latest)).where("nth = 1").drop("nth")


def heuristic(calls: Column, errors: Column) -> tuple[Column, Column]:
    """(outcome, confidence) by the share of failed calls: above 0.4 failure, none success, else partial; no call unknown."""
    outcome = F.when(calls == 0, "unknown").when(errors / F.when(calls > 0, calls) > 0.4, "failure").when(errors == 0, "success").otherwise("partial")
    return outcome, F.when(calls == 0, 0.0).when(outcome == "failure", 0.4).when(outcome == "success", 0.25).otherwise(0.3)


def with_outcome(slimmed: DataFrame) -> DataFrame:
    """Adds outcome and confidence: a weighted vote of the signals, or of the heuristic one where there are none.

    Ties go to success, then failure, then partial; if all weigh nothing the outcome is unknown.
    """
    guess, sure = heuristic(F.col("calls"), F.col("errors"))
    none = F.coalesce(F.array_size("signals"), F.lit(0)) == 0
    weight = lambda o: F.when(none, F.when(guess == o, sure).otherwise(0.0)).otherwise(F.aggregate(F.filter("signals", lambda s: s["outcome"] == o), F.lit(0.0), lambda a, s: a + F.coalesce(s["confidence"], F.lit(0.0))))
    d = slimmed.withColumns({o[0]: weight(o) for o in ("success", "failure", "partial")})
    best = F.greatest("s", "f", "p")
    outcome = F.when(best <= 0, "unknown").when(F.col("s") == best, "success").when(F.col("f") == best, "failure").otherwise("partial")
    return d.withColumns({"outcome": outcome, "confidence": F.when(best <= 0, 0.0).otherwise(F.least(F.lit(1.0), best))}).drop("s", "f", "p")


def calls_of(traces: DataFrame) -> DataFrame:
    """(id, agent, step_pos, call_pos, name, args, result, error, duration_ms), once per place of a trace."""
    steps = traces.where(F.col("id").isNotNull()).select("id", "agent", F.posexplode("steps.tool_calls").alias("step_pos", "calls"))
    return steps.select("id", "agent", "step_pos", F.posexplode("calls").alias("call_pos", "c")).select("id", "agent", "step_pos", "call_pos", "c.*").dropDuplicates(["id", "step_pos", "call_pos"])


def compact(traces: DataFrame, most: int = 12000) -> DataFrame:
    """(id, text): a readable rendering with signals and outcome, cut in the middle beyond ``most`` characters."""
    text = lambda c, n: F.left(F.coalesce(c, F.lit("")), F.lit(n))
    none = F.array().cast("array<string>")

    def lines(s: Column, i: Column) -> Column:
        at = F.concat(F.lit("["), i.cast("string"), F.lit("] "))
        said = F.when(F.coalesce(s["content"], F.lit("")) != "", F.array(F.concat(at, F.upper(F.coalesce(s["role"], F.lit(""))), F.lit(": "), text(s["content"], 800)))).otherwise(none)
        told = lambda c: F.when(F.coalesce(c["error"], F.lit("")) != "", F.concat(F.lit("\n      ERROR: "), text(c["error"], 600))).when(c["result"].isNotNull(), F.concat(F.lit("\n      -> "), text(c["result"], 400))).otherwise("")
        calls = F.transform(s["tool_calls"], lambda c: F.concat(at, F.lit("TOOL "), F.coalesce(c["name"], F.lit("")), F.lit("("), text(F.coalesce(c["args"], F.lit("{}")), 400), F.lit(")"), told(c)))
        return F.concat(said, F.coalesce(calls, none))

    calls, errors = F.coalesce(n_calls(F.col("steps.tool_calls")), F.lit(0)), F.coalesce(n_errors(F.col("steps.tool_calls")), F.lit(0))
    d = with_outcome(traces.select("id", "task", "agent", "skills_used", "steps", "signals", calls.alias("calls"), errors.alias("errors")))
    guess, sure = heuristic(F.col("calls"), F.col("errors"))
    alone = F.concat(F.lit("tool_errors="), guess, F.format_string("(%.2f) ", sure), F.when(F.col("calls") == 0, "no tool calls").otherwise(F.format_string("%d/%d tool calls errored", "errors", "calls")))
    each = F.transform("signals", lambda s: F.concat(F.coalesce(s["source"], F.lit("")), F.lit("="), F.coalesce(s["outcome"], F.lit("")), F.format_string("(%.2f) ", F.coalesce(s["confidence"], F.lit(0.0))), F.coalesce(s["detail"], F.lit(""))))
    used = F.when(F.size("skills_used") > 0, F.concat(F.lit("['"), F.array_join("skills_used", "', '"), F.lit("']"))).otherwise("none")
    parts = F.concat(
        F.array(F.concat(F.lit("TASK: "), F.coalesce("task", F.lit(""))), F.concat(F.lit("AGENT: "), F.coalesce("agent", F.lit(""))), F.concat(F.lit("SKILLS USED: "), used), F.lit("")),
        F.coalesce(F.flatten(F.transform("steps", lines)), none),
        F.array(F.lit(""), F.concat(F.lit("SIGNALS: "), F.when(F.size("signals") > 0, F.array_join(each, "; ")).otherwise(alone)), F.concat(F.lit("OUTCOME: "), F.col("outcome"), F.format_string(" (conf %.2f)", "confidence"))),
    )
    whole = F.array_join(parts, "\n")
    half = most // 2
    cut = F.concat(F.left("whole", F.lit(half)), F.lit("\n...[truncated]...\n"), F.right("whole", F.lit(half)))
    return d.select("id", whole.alias("whole")).select("id", F.when(F.length("whole") > most, cut).otherwise(F.col("whole")).alias("text"))
