"""How plans are cut, staged and broadcast, alike on one machine and on a cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and its master is local, as in tests on one machine, a temporary folder is made and
    remembered in the session's own settings; on a cluster that would be a folder of each machine, so it is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tracewell.shared.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        named = "file://" + tempfile.mkdtemp(prefix="tracewell-")
        spark.conf.set("tracewell.shared.dir", named)
    return named.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Cuts the lineage (a lost executor costs no recomputation of what is staged), keeps columns prunable and gives the
    planner true sizes for later joins.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracewell/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most_rows`` rows, else as it is, for a shuffled join.

    ``df`` should be staged or otherwise cheap to count, and its rows of bounded width.
    """
    few = df.limit(most_rows + 1).count() <= most_rows
    return F.broadcast(df) if few else df


def width(spark: SparkSession) -> int:
    """Tasks that can run at once, as far as the session knows; at least 4."""
    return max(4, spark.sparkContext.defaultParallelism)


#: Bytes up to which a scan is dealt out.
SPREAD_MOST = 4 << 30


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out evenly if its scan has fewer parts than tasks can run and at most ``SPREAD_MOST`` bytes, so that
    work in Python uses all cores; larger inputs are read where they lie, unshuffled."""
    tasks = width(df.sparkSession)
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SPREAD_MOST
    return df.repartition(tasks) if small and df.rdd.getNumPartitions() < tasks else df
