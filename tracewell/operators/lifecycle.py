"""Usage folds, curation, versions and lesson decisions, as windows and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The policy.
ACTIVATE_AFTER, DEMOTE_USES, DEMOTE_RATE = 1, 4, 0.4
RETIRE_DAYS, MAX_ACTIVE = 60, 200
LESSON_CONFIDENCE, SINGLE_CONFIDENCE = 0.4, 0.8
COLD_SIZE, COLD_CONFIDENCE, COLD_SINGLE = 12, 0.3, 0.5


def usage_fold(uses: DataFrame, skills: DataFrame) -> DataFrame:
    """(name, uses, successes, failures, status) after replaying ``uses`` (name, ts, id, outcome) in order of ts, then id,
    from the stored rows of ``skills`` (name, uses, successes, failures, status, cleared), one row a skill.

    A candidate that is cleared becomes active once it has a success; an active skill with at least 4 uses and a rate below
    0.4 goes to quarantine; other statuses stay. Skills without a use, and uses of names not in ``skills``, give no row. As
    only running counts decide, the fold is a running sum: counts by day first, then within the day from the day's start,
    so a skill with very many uses is spread over its days.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    own = skills.select("name", zero("uses").alias("u0"), zero("successes").alias("s0"), zero("failures").alias("f0"), "status", F.coalesce("cleared", F.lit(False)).alias("cleared"))
    d = uses.where(F.col("name").isNotNull() & F.col("ts").isNotNull()).join(own.select("name"), "name", "left_semi").withColumn("day", F.floor(F.col("ts") / 86400))
    won, lost = F.count_if(F.col("outcome") == "success"), F.count_if(F.col("outcome") == "failure")
    days = d.groupBy("name", "day").agg(F.count("*").alias("n"), won.alias("w"), lost.alias("l"))
    before = Window.partitionBy("name").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    starts = days.select("name", "day", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in "nw"))
    within = Window.partitionBy("name", "day").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    run = d.join(starts, ["name", "day"]).select("name", (F.col("n0") + F.count("*").over(within)).alias("n"), (F.col("w0") + F.count_if(F.col("outcome") == "success").over(within)).alias("w"))
    run = run.join(own, "name").select("name", (F.col("u0") + F.col("n")).alias("n"), (F.col("s0") + F.col("w")).alias("w"), (F.coalesce(F.col("status") == "active", F.lit(False)) | (F.coalesce(F.col("status") == "candidate", F.lit(False)) & F.col("cleared") & (F.col("s0") + F.col("w") >= ACTIVATE_AFTER))).alias("on"))
    ever = run.groupBy("name").agg(F.bool_or("on").alias("on"), F.bool_or(F.col("on") & (F.col("n") >= DEMOTE_USES) & (F.col("w") / F.col("n") < DEMOTE_RATE)).alias("fallen"))
    total = days.groupBy("name").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("l").alias("l"))
    status = F.when(F.col("fallen"), "quarantine").when(F.col("on"), "active").otherwise(F.col("status"))
    return total.join(ever, "name").join(own, "name").select("name", (F.col("u0") + F.col("n")).alias("uses"), (F.col("s0") + F.col("w")).alias("successes"), (F.col("f0") + F.col("l")).alias("failures"), status.alias("status"))


def curate(skills: DataFrame, now: Column, most: int = MAX_ACTIVE, days: int = RETIRE_DAYS) -> DataFrame:
    """(name, action): active skills to retire (never used and idle for ``days``) or, of the rest, to quarantine.

    Beyond ``most`` active skills the least by (rate, uses, name) go; the cap is the feature. Places are found by
    counting from bins of rate, without sorting all skills in one task.
    """
    idle = (now - F.when(F.coalesce("last_used", F.lit(0.0)) > 0, F.col("last_used")).otherwise(F.col("created"))) / 86400
    rate = F.coalesce(F.col("successes") / F.when(F.col("uses") > 0, F.col("uses")), F.lit(0.0))
    d = skills.where("status = 'active'").select("name", "uses", rate.alias("rate"), ((idle > days) & (F.coalesce("uses", F.lit(0)) == 0)).alias("old"))
    left = d.where("not coalesce(old, false)").withColumn("bin", F.floor(F.col("rate") * 1000))
    bins = left.groupBy("bin").agg(F.count("*").alias("c"))
    above = bins.withColumn("above", F.coalesce(F.sum("c").over(Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # at most 1001 rows
    place = F.col("above") + F.row_number().over(Window.partitionBy("bin").orderBy(F.desc("rate"), F.desc("uses"), F.desc("name")))
    capped = left.join(F.broadcast(above), "bin").withColumn("place", place).where(F.col("place") > most)
    return d.where("old").select("name", F.lit("retire").alias("action")).unionByName(capped.select("name", F.lit("quarantine").alias("action")))


def versions(skills: DataFrame) -> DataFrame:
    """(name, versions, latest, next): the distinct versions of each name in order, and the one a rollback would write."""
    d = skills.where(F.col("name").isNotNull() & F.col("version").isNotNull()).groupBy("name").agg(F.sort_array(F.collect_set("version")).alias("versions"))
    return d.select("name", "versions", F.array_max("versions").alias("latest"), (F.array_max("versions") + 1).alias("next"))


def scd2(changes: DataFrame, key: str, at: str, order: list[str]) -> DataFrame:
    """``changes`` with version, valid_from, valid_to and current, numbered per key in order of time."""
    w = Window.partitionBy(key).orderBy(at, *order)
    return changes.withColumns({"version": F.row_number().over(w), "valid_from": F.col(at), "valid_to": F.lead(at).over(w)}).withColumn("current", F.col("valid_to").isNull())


def latest_lessons(lessons: DataFrame) -> DataFrame:
    """A row per id: rows stored twice count once."""
    return lessons.where(F.col("id").isNotNull()).dropDuplicates(["id"])


def grounding(lessons: DataFrame, calls: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """(id, cited, cap): whether a cited step of the lesson's trace has a failed call, and the confidence that is left.

    For a lesson that isn't a success, without evidence and with a cause other than 'undetermined', at most 0.35 is left;
    with a failed cited step at most 0.75. Else, of one that isn't a success, has 0.5 or more and a cause that is neither
    undetermined nor unsupported, the sceptic decides if there is one: ``answers`` (id, support, quoted): direct and quoted
    leaves all, partial and quoted at most 0.65, anything else 0.35. Without an answer it keeps what it had.
    """
    failed = calls.where(F.coalesce(F.col("error") != "", F.lit(False))).select(F.col("id").alias("trace_id"), F.col("step_pos").alias("step")).distinct()
    cites = lessons.select("id", "trace_id", F.explode("evidence_steps").alias("step")).join(failed, ["trace_id", "step"], "left_semi").select("id").distinct().withColumn("cited", F.lit(True))
    d = lessons.join(cites, "id", "left").withColumn("cited", F.coalesce("cited", F.lit(False)))
    none = F.coalesce(F.array_size("evidence_steps"), F.lit(0)) == 0
    bad = F.coalesce(F.col("outcome") != "success", F.lit(True))
    cause = F.lower(F.trim(F.coalesce("root_cause", F.lit(""))))
    c = F.coalesce("confidence", F.lit(0.0))
    guess = none & bad & ~cause.startswith("undetermined")
    first = F.when(guess, F.least(c, F.lit(0.35))).otherwise(c)
    sceptic = F.lit(None).cast("double")
    if answers is not None:
        d = d.join(answers.select("id", F.lower("support").alias("_s"), F.coalesce("quoted", F.lit(False)).alias("_q")), "id", "left")
        told = F.when((F.col("_s") == "direct") & F.col("_q"), first).when((F.col("_s") == "partial") & F.col("_q"), F.least(first, F.lit(0.65))).otherwise(F.least(first, F.lit(0.35)))
        sceptic = F.when(F.col("_q").isNotNull() & bad & (first >= 0.5) & ~guess & ~cause.startswith("undetermined") & ~cause.startswith("unsupported"), told)
    cap = F.when(F.col("cited"), F.least(first, F.lit(0.75))).otherwise(F.coalesce(sceptic, first))
    return d.select("id", "cited", cap.alias("cap"))


def decisions(lessons: DataFrame, outcomes: DataFrame, skills: DataFrame, duplicates: DataFrame, related: DataFrame, evals: DataFrame) -> DataFrame:
    """(id, decision, name): what each lesson leads to, the first that fits, and the skill it is about.

    'orphan' (its trace is gone), 'eval run', 'trivial' (fewer than two calls and no failure), 'unknown outcome', 'not
    general', 'low confidence', 'contributed' (its trace stands in the provenance of a live skill), 'resume' (of a skill in
    quarantine that was never evaluated), 'single evidence', 'patch', 'create'. The skill is the one blamed, else a
    duplicate. ``outcomes``: trace_id, eval_id, calls, trace_outcome; ``skills``: name, status, provenance, one row a skill;
    ``duplicates``: id, name; ``related``: ids of lessons with a related one; ``evals``: names of skills with an evaluation.
    In a library of fewer than 12 live skills the thresholds are lower.
    """
    size = skills.agg(F.count_if(F.col("status").isin("active", "candidate")).alias("_size"))
    least = F.when(F.col("_size") < COLD_SIZE, COLD_CONFIDENCE).otherwise(LESSON_CONFIDENCE)
    alone = F.when(F.col("_size") < COLD_SIZE, COLD_SINGLE).otherwise(SINGLE_CONFIDENCE)
    blamed = F.when(F.col("blame").isin("skill_wrong", "skill_incomplete", "skill_misapplied"), F.col("skill_ref"))
    d = lessons.select("id", "trace_id", "generalizable", "confidence", blamed.alias("_blamed")).join(outcomes.select("trace_id", "eval_id", "calls", "trace_outcome"), "trace_id", "left")
    d = d.join(skills.select(F.col("name").alias("_blamed"), F.lit(True).alias("_known")), "_blamed", "left").join(duplicates.select("id", F.col("name").alias("_twin")), "id", "left")
    d = d.withColumn("name", F.when(F.col("_known"), F.col("_blamed")).otherwise(F.col("_twin")))
    d = d.join(skills.select("name", "status", "provenance"), "name", "left")
    d = d.join(related.select("id").distinct().withColumn("_related", F.lit(True)), "id", "left").join(evals.select("name").distinct().withColumn("_tried", F.lit(True)), "name", "left").join(F.broadcast(size))
    c = F.coalesce("confidence", F.lit(0.0))
    mine = F.coalesce(F.array_contains("provenance", F.col("trace_id")), F.lit(False))
    what = (
        F.when(F.col("calls").isNull(), "orphan").when(F.col("eval_id").isNotNull(), "eval run").when((F.col("calls") < 2) & (F.col("trace_outcome") != "failure"), "trivial")
        .when(F.col("trace_outcome") == "unknown", "unknown outcome").when(~F.coalesce("generalizable", F.lit(False)), "not general").when(c < least, "low confidence")
        .when(mine & F.col("status").isin("active", "candidate"), "contributed").when(mine & (F.col("status") == "quarantine") & F.col("_tried").isNull(), "resume")
        .when(F.col("name").isNull() & F.col("_related").isNull() & (c < alone), "single evidence").when(F.col("name").isNotNull(), "patch").otherwise("create")
    )
    return d.select("id", what.alias("decision"), "name")


def evidence(lessons: DataFrame) -> DataFrame:
    """(name, lessons, traces, provisional): distinct lessons and traces behind each skill; fewer than two are provisional."""
    d = lessons.where(F.col("skill_ref").isNotNull()).groupBy(F.col("skill_ref").alias("name")).agg(F.count_distinct("id").alias("lessons"), F.count_distinct("trace_id").alias("traces"))
    return d.withColumn("provisional", F.col("lessons") < 2)


def context_tail(rows: DataFrame, key: str, order: list, text: str, most: int = 8000) -> DataFrame:
    """(key, context): the last ``most`` characters of a key's texts, joined by blank lines in order.

    Only rows that reach into the last ``most`` characters are gathered, so a key with very many rows stays bounded.
    """
    back = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    size = F.length(text) + 2
    d = rows.where(F.col(key).isNotNull() & F.col(text).isNotNull()).withColumn("after", F.coalesce(F.sum(size).over(back.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("after") < most)
    listed = d.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("t")))).alias("x"))
    return listed.select(key, F.right(F.array_join(F.transform("x", lambda s: s["t"]), "\n\n"), F.lit(most)).alias("context"))
