"""Each batch of a stream delivered once, whole, to tables that readers see only when it is committed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

GOOD, LATE, CORRUPT = "good", "late", "corrupt"
_COMMIT = "query_name string, batch_id long, rows long, last_time timestamp"


def _commits(spark: SparkSession, location: str) -> DataFrame:
    """One row per delivered batch of each query; none before the first."""
    folder = f"{location.rstrip('/')}/commits"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _COMMIT)
    return spark.read.schema(_COMMIT).parquet(folder).distinct()


def deliver(
    df: DataFrame, location: str, checkpoint: str, *, name: str, time_col: str | None = None, prepare: Callable[[DataFrame, DataFrame], DataFrame] | None = None, interval: str | None = None
) -> StreamingQuery:
    """Start a stream whose batches go to ``location`` and count once their commit, keyed by ``name`` and batch id, is written.

    A batch lies in a folder of its own. When Spark repeats one after a failure, an uncommitted folder is written anew and a committed
    batch is skipped, so a killed and restarted query has every row once. ``prepare`` gets the batch and the commits before it.
    """
    root = location.rstrip("/")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _commits(spark, root).where(F.col("query_name") == name)
        if not before.where(F.col("batch_id") == batch_id).isEmpty():
            return
        rows = prepare(batch, before.where(F.col("batch_id") < batch_id)) if prepare else batch
        folder = f"{root}/batches/query_name={name}/batch_id={batch_id}"
        rows.write.mode("overwrite").parquet(folder)
        last = F.max(F.col(time_col).cast("timestamp")) if time_col else F.lit(None).cast("timestamp")
        # Counted from what was written, so the batch is not computed again.
        found = spark.read.schema(rows.schema).parquet(folder).agg(F.count(F.lit(1)).alias("rows"), last.alias("last_time"))
        committed = found.select(F.lit(name).alias("query_name"), F.lit(batch_id).cast("long").alias("batch_id"), "rows", "last_time")
        committed.coalesce(1).write.mode("append").parquet(f"{root}/commits")

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def read_delivered(spark: SparkSession, location: str, schema: T.StructType) -> DataFrame:
    """The rows of committed batches, with ``query_name`` and ``batch_id``. Commits have a row per batch."""
    root = location.rstrip("/")
    keyed = T.StructType([*schema.fields, T.StructField("query_name", T.StringType()), T.StructField("batch_id", T.LongType())])
    commits = _commits(spark, root)
    if commits.isEmpty():
        return spark.createDataFrame([], keyed)
    rows = spark.read.schema(keyed).option("basePath", f"{root}/batches").parquet(f"{root}/batches")
    return rows.join(commits.select("query_name", "batch_id"), ["query_name", "batch_id"], "left_semi").select(*keyed.names)


def route_records(parsed: DataFrame, location: str, checkpoint: str, *, name: str = "telemetry", time_col: str = "ts", delay: str = "2 minutes") -> StreamingQuery:
    """Deliver every parsed record with ``route``: ``good``, ``late`` or ``corrupt`` (its text is in ``_corrupt``).

    A record is late if its time lies more than ``delay`` before the latest time of the batches before, which is what a watermark
    of that delay would drop. All routes of a batch are committed together, so a record is in exactly one of them.
    """

    def tag(batch: DataFrame, before: DataFrame) -> DataFrame:
        border = before.agg((F.max("last_time") - F.expr(f"interval {delay}")).alias("t")).first()["t"]  # one row per batch
        late = F.lit(False) if border is None else F.coalesce(F.col(time_col) < F.lit(border), F.lit(False))
        return batch.withColumn("route", F.when(F.col("_corrupt").isNotNull(), CORRUPT).when(late, LATE).otherwise(GOOD))

    return deliver(parsed, location, checkpoint, name=name, time_col=time_col, prepare=tag)
