"""Reports over episodes, arms, probes and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.stats import sign_test, wilson


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key that is last by ``order``: upserts and resumable caches."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order))
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def missing_jobs(wanted: DataFrame, done: DataFrame, keys: list[str], failed: Column | None = None) -> DataFrame:
    """Rows of ``wanted`` without a result; results that ``failed`` don't count."""
    return wanted.join(done.where(~F.coalesce(failed, F.lit(False))) if failed is not None else done, keys, "left_anti")


def episodes(df: DataFrame) -> DataFrame:
    """By condition: k of n episodes that passed at last and at first, interval, mean context, and harness errors left out.

    ``df``: condition, attempts ARRAY<BOOLEAN>, harness_error, context_chars; no attempt is a failure.
    """
    bad = F.col("harness_error").isNotNull()
    last, first = (F.coalesce(F.try_element_at("attempts", F.lit(i)), F.lit(False)) for i in (-1, 1))
    d = df.groupBy("condition").agg(
        F.count_if(~bad & last).alias("k"), F.count_if(~bad & first).alias("first_k"), F.count_if(~bad).alias("n"), F.count_if(bad).alias("errors"), F.avg(F.when(~bad, F.coalesce("context_chars", F.lit(0)))).alias("context")
    )
    low, high = wilson(F.col("k"), F.col("n"))
    return d.withColumns({"low": low, "high": high})


def ab(df: DataFrame, on: str, off: str) -> DataFrame:
    """One row: tasks, wins and losses by task rate; trials, wins and losses by trial; both sign tests.

    ``df``: task, arm, ok ARRAY<BOOLEAN>. Only tasks with both arms count; trials are paired up to the shorter arm.
    """
    side = lambda arm, c: df.where(F.col("arm") == arm).select("task", F.col("ok").alias(c))
    d = side(on, "x").join(side(off, "y"), "task").where((F.size("x") > 0) & (F.size("y") > 0))
    share = lambda c: F.aggregate(c, F.lit(0), lambda a, v: a + v.cast("int")) / F.size(c)
    n = F.least(F.size("x"), F.size("y"))
    pairs = F.arrays_zip(F.slice("x", F.lit(1), n).alias("x"), F.slice("y", F.lit(1), n).alias("y"))
    d = d.select(share("x").alias("rx"), share("y").alias("ry"), n.alias("n"), F.size(F.filter(pairs, lambda p: p["x"] & ~p["y"])).alias("w"), F.size(F.filter(pairs, lambda p: ~p["x"] & p["y"])).alias("l"))
    s = d.agg(F.count("*").alias("tasks"), F.count_if(F.col("rx") > F.col("ry")).alias("wins"), F.count_if(F.col("rx") < F.col("ry")).alias("losses"), F.sum("n").alias("trials"), F.sum("w").alias("trial_wins"), F.sum("l").alias("trial_losses"))
    return s.withColumns({"p": sign_test(F.col("wins"), F.col("losses")), "trial_p": sign_test(F.coalesce("trial_wins", F.lit(0)), F.coalesce("trial_losses", F.lit(0)))})


def principles(df: DataFrame, least: int = 3) -> DataFrame:
    """Principles (rule, ids) that at least ``least`` different lessons support."""
    return df.where(F.size(F.array_distinct("ids")) >= least)


def informative(attempts: DataFrame) -> DataFrame:
    """By convention: training attempts and those that failed in code, which tell something; 'rich' if any did.

    ``attempts``: convention, stage.
    """
    d = attempts.groupBy("convention").agg(F.count("*").alias("attempts"), F.count_if(F.col("stage") == "code").alias("told"))
    return d.withColumn("rich", F.col("told") > 0)


def red_flags(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, in order."""
    return F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())


def probe_eval(found: DataFrame, probes: DataFrame) -> DataFrame:
    """By class: probes, hits at rank 1, right abstentions, false fires. ``found``: qid, rank, name; ``probes``: class, qid, target (null: abstain)."""
    d = probes.join(found.where("rank = 1").select("qid", "name"), "qid", "left")
    return d.groupBy("class").agg(
        F.count("*").alias("n"), F.count_if(F.col("target") == F.col("name")).alias("hits"), F.count_if(F.col("target").isNull() & F.col("name").isNull()).alias("abstained"), F.count_if(F.col("target").isNull() & F.col("name").isNotNull()).alias("false_fires")
    )


def upper_median(by: list[str], value: str, df: DataFrame) -> DataFrame:
    """The upper median of ``value``: of an even number of values the greater of the middle two."""
    return df.groupBy(*by).agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC)").alias("median"))


def check_summary(df: DataFrame) -> DataFrame:
    """By task: whether every part passed, and the least index that failed. ``df``: task, part, index, status."""
    return df.groupBy("task").agg(F.bool_and(F.col("status") == "pass").alias("passed"), F.min(F.when(F.col("status") != "pass", F.col("index"))).alias("first_failure"))


def degradation(df: DataFrame, value: str, most: float = 2.0) -> DataFrame:
    """(size, value, flagged): whether a value per size exceeds ``most`` times that of the least size."""
    first = df.agg(F.min_by(value, "size").alias("base"))
    return df.join(F.broadcast(first)).select("size", value, (F.col(value) > most * F.col("base")).alias("flagged"))


def seeded_split(df: DataFrame, key: str, seed: int, first: int) -> DataFrame:
    """``df`` with part 'a' for the first ``first`` keys in an order that only the seed decides, else 'b'."""
    w = Window.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)  # a table of tasks of fixed size
    return df.withColumn("part", F.when(F.row_number().over(w) <= first, "a").otherwise("b"))
