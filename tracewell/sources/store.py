"""A store of append-only Parquet tables: upserts by latest row, flags and counters as rows of their own, versions, backups.

A row is never changed: a table's view takes the last row of each key by (batch, place), so a store on shared files needs no
locks for readers; writers of one table take turns, as a batch number follows the greatest there is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Version of the layout, and what each version adds.
VERSION = 1
MIGRATIONS = {1: ("principles", "metrics")}
SCHEMAS = {
    "traces": "id string, ts double, json string", "processed": "id string", "lessons": "id string, trace_id string, ts double, json string", "skills": "name string, version int, status string, description string, body string, triggers array<string>",
    "recalls": "name string", "evals": "id string, skill string, kind string, status string, ts double", "audit": "ts double, kind string, subject string, detail string", "principles": "id string, ts double, rule string, evidence int, active boolean", "metrics": "ts double, key string, value double", "layout": "version int",
}
KEYS = {"traces": ["id"], "processed": ["id"], "lessons": ["id"], "skills": ["name"], "evals": ["id"], "principles": ["id"]}


class Store:
    """Tables below one folder; opening makes what is missing and runs the migrations."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.applied = self.migrate()

    def history(self, name: str) -> DataFrame:
        """All rows of a table with their batch and place; empty if it was never written."""
        schema = f"{SCHEMAS[name]}, _batch bigint, _place bigint"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as e:  # the folder isn't there yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def add(self, name: str, rows: DataFrame) -> int:
        """Append rows as one batch, later rows winning over earlier ones of their key; its number. Missing columns are null."""
        batch = (self.history(name).agg(F.max("_batch")).first()[0] or 0) + 1
        want = self.spark.createDataFrame([], SCHEMAS[name]).schema
        cols = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want]
        rows.select(*cols, F.lit(batch).cast("bigint").alias("_batch"), F.monotonically_increasing_id().alias("_place")).write.mode("append").parquet(f"{self.path}/{name}")
        return batch

    def table(self, name: str) -> DataFrame:
        """The last row of each key, or all rows of a table without a key."""
        d = self.history(name)
        if name not in KEYS:
            return d.drop("_batch", "_place")
        w = Window.partitionBy(*KEYS[name]).orderBy(F.desc("_batch"), F.desc("_place"))
        return d.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_batch", "_place")

    def migrate(self) -> list[int]:
        """Run the migrations that weren't yet; their versions. Running again does nothing."""
        have = self.history("layout").agg(F.max("version")).first()[0] or 0
        todo = [v for v in range(have + 1, VERSION + 1)]
        for v in todo:
            self.add("layout", self.spark.createDataFrame([(v,)], "version int"))
        return todo

    def pending(self, most: int | None = None) -> DataFrame:
        """Traces whose last row is newer than their mark, oldest first."""
        w = Window.partitionBy("id").orderBy(F.desc("_batch"), F.desc("_place"))
        new = self.history("traces").withColumn("_n", F.row_number().over(w)).where("_n = 1")
        done = self.history("processed").groupBy("id").agg(F.max("_batch").alias("_done"))
        # A mark names the batch of traces it was made after, so a trace that is stored again is pending again.
        d = new.join(done, "id", "left").where(F.col("_done").isNull() | (F.col("_done") < F.col("_batch"))).select("id", "ts", "json").orderBy("ts", "id")
        return d if most is None else d.limit(most)

    def mark_processed(self, ids: DataFrame) -> None:
        """Mark the traces of these ids as processed."""
        batch = self.history("traces").agg(F.max("_batch")).first()[0] or 0
        ids.select("id", F.lit(batch).cast("bigint").alias("_batch"), F.monotonically_increasing_id().alias("_place")).write.mode("append").parquet(f"{self.path}/processed")

    def save_skills(self, skills: DataFrame) -> int:
        """Upsert skills; null triggers keep the ones there are."""
        old = self.table("skills").select("name", F.col("triggers").alias("_old"))
        d = skills.join(old, "name", "left")
        return self.add("skills", d.withColumn("triggers", F.coalesce("triggers" if "triggers" in skills.columns else F.lit(None).cast("array<string>"), "_old")))

    def recalled(self) -> DataFrame:
        """(name, recalls): how often each skill was shown; a row of the table for each showing."""
        return self.history("recalls").groupBy("name").agg(F.count("*").alias("recalls"))

    def versions(self, name: str) -> list[int]:
        """The versions of a skill in order (one skill's own)."""
        return [r[0] for r in self.history("skills").where(F.col("name") == name).select("version").distinct().orderBy("version").collect()]

    def rollback(self, name: str, version: int) -> int:
        """Write ``version`` of a skill again as its next version, active; the number of that version."""
        own = self.history("skills").where(F.col("name") == name)
        top = own.agg(F.max("version")).first()[0]
        row = own.where(F.col("version") == version).orderBy(F.desc("_batch"), F.desc("_place")).limit(1)
        if top is None or row.isEmpty():
            raise KeyError(f"no version {version} of {name}")
        self.add("skills", row.withColumns({"version": F.lit(top + 1), "status": F.lit("active")}))
        return top + 1

    def backup(self, path: str) -> None:
        """Copy all rows of all tables to another folder, by Spark."""
        for name in SCHEMAS:
            self.history(name).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")

    def restore(self, path: str) -> None:
        """Take the rows of a backup in place of those there are; a folder that isn't a store is refused."""
        Backup = Store.__new__(Store)
        Backup.spark, Backup.path = self.spark, path.rstrip("/")
        if Backup.history("layout").isEmpty():
            raise FileNotFoundError(path)
        for name in SCHEMAS:
            Backup.history(name).write.mode("overwrite").parquet(f"{self.path}/{name}")
