"""Sources: one factory for batch and stream, CSV tables and matrices, log files, model tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telewarden.sources.writers import MANIFEST, MANIFEST_SCHEMA

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def open_values(
    spark: SparkSession,
    location: str,
    *,
    fmt: str = "text",
    streaming: bool = False,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """String records as a ``value`` column, from files or from a broker topic.

    With ``fmt='kafka'`` ``location`` is the topic and ``options`` carries the
    broker settings; reading starts at the earliest offset. The connector has to be on the
    class path.
    """
    options = dict(options or {})
    reader = spark.readStream if streaming else spark.read
    if fmt == "kafka":
        options.setdefault("startingOffsets", "earliest")
        raw = reader.format("kafka").options(subscribe=location, **options).load()
        return raw.select(F.col("value").cast("string").alias("value"), F.col("timestamp").alias("ingest_time"))
    if fmt == "parquet" and streaming:
        return reader.schema("value string").options(**options).parquet(location)
    return reader.format(fmt).options(**options).load(location).select("value")


def open_records(spark: SparkSession, location: str, schema: T.StructType, *, fmt: str = "parquet", streaming: bool = False, options: Mapping[str, str] | None = None) -> DataFrame:
    """Structured records (features, scores) with a declared schema."""
    reader = spark.readStream if streaming else spark.read
    return reader.format(fmt).schema(schema).options(**dict(options or {})).load(location)


def read_csv_table(spark: SparkSession, location: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header line; give a schema to avoid the extra inference pass."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(location)


def read_csv_matrix(spark: SparkSession, location: str, width: int, *, ids: Sequence[str] = ()) -> DataFrame:
    """Headerless numeric CSV as ``features array<double>``; leading ``ids`` columns are kept apart."""
    names = [*ids, *[f"c{i}" for i in range(width)]]
    schema = T.StructType([T.StructField(n, T.LongType() if n in ids else T.DoubleType()) for n in names])
    raw = spark.read.schema(schema).csv(location)
    return raw.select(*ids, F.array(*[F.col(f"c{i}") for i in range(width)]).alias("features"))


def read_labels(spark: SparkSession, location: str) -> DataFrame:
    """``row_id,label`` lines; labels may be written as floats and are truncated to int."""
    raw = spark.read.schema("row_id bigint, label double").csv(location)
    return raw.select("row_id", F.col("label").cast("int").alias("y_true"))


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Dense 0-based ids in scan order, for files whose only row identity is position.

    The partition totals are as many rows as the scan has partitions.
    """
    tagged = df.withColumn("_mid", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_mid", 33))
    totals = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.col("_mid") - F.shiftleft(F.col("_part"), 33)
    return tagged.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + inside).drop("_mid", "_part", "_start")


def read_logs(spark: SparkSession, location: str, *, tag: str | Column | None = None, streaming: bool = False, max_line: int | None = None) -> DataFrame:
    """Log lines below ``location`` as ``tag, log``.

    Without ``tag`` it is the name of the folder a file lies in; over-long lines
    are dropped when ``max_line`` is set.
    """
    reader = spark.readStream if streaming else spark.read
    options = {"recursiveFileLookup": "true"}
    raw = (reader.schema("value string") if streaming else reader).options(**options).text(location)
    if tag is None:
        folder = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -2), "^tag=", "")
        # File names are percent-encoded in paths, and partition folders once more when they are written.
        once = F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))
        tag = F.when(F.input_file_name().rlike("/tag=[^/]*/[^/]*$"), F.url_decode(F.replace(once, F.lit("+"), F.lit("%2B")))).otherwise(once)
    elif isinstance(tag, str):
        tag = F.lit(tag)
    lines = raw.select(tag.alias("tag"), F.col("value").alias("log"))
    return lines if max_line is None else lines.where(F.length("log") <= max_line)


def read_model(spark: SparkSession, location: str) -> dict[str, DataFrame]:
    """All parts of the newest complete version of a model; a missing part is an error, never replaced by something random."""
    root = location.rstrip("/")
    versions = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{root}/{MANIFEST}")
    newest = versions.orderBy(F.col("number").desc(), F.col("version").desc()).first()
    if newest is None:
        raise FileNotFoundError(f"no complete model below {location}")
    return {part: spark.read.parquet(f"{root}/{newest['version']}/{part}") for part in newest["parts"]}
