"""Sources and sinks of files: episodes and transcripts by line, fixtures, append-only tables with latest and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPISODE = "task_id string, condition string, attempts array<struct<code:string,verdict:struct<ok:boolean,stage:string,error:string>>>, harness_error string, hints_shown array<string>, context_chars long"
SKILL = "name string, description string, applies_when array<string>, symptoms array<string>, not_for array<string>, queries array<string>"


def episodes(spark: SparkSession, path: str) -> DataFrame:
    """Episodes of JSON lines: blank and broken lines are left out; the last line of a task and condition in a file wins."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), F.col("value"))
    d = lines.where(F.trim("value") != "").select("file", "line", F.from_json("value", EPISODE).alias("e")).where("e.task_id is not null").select("file", "line", "e.*")
    w = Window.partitionBy("file", "task_id", "condition").orderBy(F.desc("line"))
    return d.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth", "line").withColumn("context_chars", F.coalesce("context_chars", F.lit(0)))


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, role, text) of transcript lines whose message has a role; others are left out."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), F.try_parse_json("value").alias("v"))
    text = F.coalesce(F.try_variant_get("v", "$.message.content", "string"), F.lit(""))
    return lines.select("file", "line", F.try_variant_get("v", "$.message.role", "string").alias("role"), text.alias("text")).where("role is not null")


def first_task(t: DataFrame) -> DataFrame:
    """(file, task): the first non-empty user text of each transcript."""
    return t.where((F.col("role") == "user") & (F.trim("text") != "")).groupBy("file").agg(F.min_by("text", "line").alias("task"))


def skills_file(spark: SparkSession, path: str) -> DataFrame:
    """Skills of a JSON array."""
    return spark.read.schema(SKILL).option("multiLine", True).json(path)


def distractors(spark: SparkSession, templates: DataFrame, n: int) -> DataFrame:
    """``n`` skills from numbered templates (at, name, description): skill i follows template i modulo their number."""
    k = templates.count()
    return spark.range(n).withColumn("at", F.pmod("id", F.lit(max(k, 1)))).join(F.broadcast(templates), "at").select(F.concat("name", F.lit("-"), F.col("id").cast("string")).alias("name"), "description")


def append(df: DataFrame, path: str) -> None:
    """Append rows, with their time of writing: upserts, audit events, metrics."""
    df.withColumn("_written", F.current_timestamp()).write.mode("append").option("mergeSchema", True).parquet(path)


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The row of each key that was written last; files of an older schema give nulls for newer columns."""
    w = Window.partitionBy(*keys).orderBy(F.desc("_written"))
    return spark.read.option("mergeSchema", True).parquet(path).withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth", "_written")


def rollback(history: DataFrame, name: str, version: int) -> DataFrame:
    """The row that restores ``version`` of ``name``: its contents under the next version number, active again."""
    own = history.where(F.col("name") == name)
    top = own.agg((F.max("version") + 1).alias("_next"))
    return own.where(F.col("version") == version).join(F.broadcast(top)).withColumns({"version": F.col("_next").cast("int"), "status": F.lit("active")}).drop("_next")


def export_markdown(skills: DataFrame, path: str) -> None:
    """One text row per skill, in folders by status: front matter and body."""
    from tracewell.functions.messages import yaml_quote

    text = F.concat(F.lit("---\nname: "), yaml_quote(F.col("name")), F.lit("\ndescription: "), yaml_quote(F.col("description")), F.lit("\n---\n"), F.coalesce("body", F.lit("")))
    skills.select(F.coalesce("status", F.lit("none")).alias("status"), F.to_json(F.struct("name", text.alias("text"))).alias("value")).write.mode("overwrite").partitionBy("status").text(path)
