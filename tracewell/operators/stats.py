"""Rates, intervals, exact tests and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of k of n, clamped to [0, 1]; (0, 0) for n = 0."""
    m = F.when(n > 0, n.cast("double"))
    p = k / m
    mid = (p + z * z / (2 * m)) / (1 + z * z / m)
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)
    return F.when(n > 0, F.greatest(F.lit(0.0), mid - half)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), mid + half)).otherwise(0.0)


def sign_test(wins: Column, losses: Column) -> Column:
    """Exact two-sided sign test, min(1, 2 sum C(n, i) / 2^n for i up to the lesser); 1 for no pair.

    The terms are built by their ratio, in logarithms, so that many pairs don't underflow.
    """
    n, k = (wins + losses).cast("int"), F.least(wins, losses).cast("int")
    start = F.struct((-n * F.log(F.lit(2.0))).alias("t"), F.exp(-n * F.log(F.lit(2.0))).alias("s"))
    step = lambda a, i: F.struct((a["t"] + F.log((n - i + 1) / i.cast("double"))).alias("t"), (a["s"] + F.exp(a["t"] + F.log((n - i + 1) / i.cast("double")))).alias("s"))
    upto = F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(upto, start, step)["s"]))


def rate(df: DataFrame, by: list[str], ok: str) -> DataFrame:
    """by, k, n, rate, low, high: successes, trials, their share and its interval; rows with a null ``ok`` are left out."""
    d = df.where(F.col(ok).isNotNull()).groupBy(*by).agg(F.count_if(ok).alias("k"), F.count("*").alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return d.select(*by, "k", "n", (F.col("k") / F.col("n")).alias("rate"), low.alias("low"), high.alias("high"))


def paired(a: DataFrame, b: DataFrame, key: str, ok: str) -> DataFrame:
    """One row: pairs, wins and losses of a against b on common keys, and the sign test of the discordant ones."""
    d = a.select(key, F.col(ok).alias("x")).join(b.select(key, F.col(ok).alias("y")), key).where("x is not null and y is not null")
    s = d.agg(F.count("*").alias("pairs"), F.count_if(F.col("x") & ~F.col("y")).alias("wins"), F.count_if(~F.col("x") & F.col("y")).alias("losses"))
    return s.withColumn("p", sign_test(F.col("wins"), F.col("losses")))


def gates(control: Column, repeat_agreement: Column, oracle: Column, harness_errors: Column) -> Column:
    """Whether a comparison is valid: agreement 0.85, control at most 0.70, oracle 0.30 above it, errors at most 5 %."""
    return (repeat_agreement >= 0.85) & (control <= 0.70) & (oracle - control >= 0.30) & (harness_errors <= 0.05)


def verdict(p: Column, wins: Column, losses: Column, drop: Column) -> Column:
    """'harm' for a drop above 0.15, 'better' or 'worse' where p < 0.05, else 'no difference shown'."""
    return F.when(drop > 0.15, "harm").when((p < 0.05) & (wins > losses), "better").when((p < 0.05) & (losses > wins), "worse").otherwise("no difference shown")


def prf(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """One row: precision, recall and F1 of distinct ``found`` against distinct ``truth``; null where undefined."""
    hit = F.lit(True)
    d = found.select(*keys).distinct().withColumn("f", hit).join(truth.select(*keys).distinct().withColumn("t", hit), keys, "full")
    s = d.agg(F.count_if(F.col("f") & F.col("t")).alias("tp"), F.count("f").alias("nf"), F.count("t").alias("nt"))
    p, r = F.col("tp") / F.when(F.col("nf") > 0, F.col("nf")), F.col("tp") / F.when(F.col("nt") > 0, F.col("nt"))
    return s.select("tp", p.alias("precision"), r.alias("recall"), (2 * p * r / F.when(p + r > 0, p + r)).alias("f1"))
