"""Sinks: JSON lines, fixed-point CSV, reports, model tables and streams."""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from telewarden.session import small_table


def write_json_lines(df: DataFrame, location: str) -> str:
    df.write.mode("errorifexists").json(location)
    return location


def write_feature_csv(df: DataFrame, location: str, cols: Sequence[str], *, ids: Sequence[str] = ()) -> str:
    """Headerless CSV, every number with six decimals."""
    df.select(*[F.col(i) for i in ids], *[fixed_point(F.col(c)).alias(c) for c in cols]).write.csv(location)
    return location


def fixed_point(x: Column) -> Column:
    return F.format_string("%.6f", x.cast("double"))


def write_csv_table(df: DataFrame, location: str) -> str:
    df.write.option("header", True).csv(location)
    return location


def write_report(report: DataFrame, location: str) -> str:
    """A one-row report as JSON."""
    report.coalesce(1).write.json(location)
    return location


MANIFEST = "manifest"
MANIFEST_SCHEMA = "number long, version string, parts array<string>"


def save_model(parts: Mapping[str, DataFrame], location: str) -> str:
    """Write the parts as a new version, and only then a row that names it.

    Spark commits that row as a whole, so readers find a complete version or the one before; what a failed writer leaves is never read.
    """
    root, version = location.rstrip("/"), f"version-{uuid.uuid4().hex}"
    for name, table in parts.items():
        table.write.parquet(f"{root}/{version}/{name}")
    spark = next(iter(parts.values())).sparkSession
    row = [(time.time_ns(), version, sorted(parts))]
    small_table(spark, row, MANIFEST_SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/{MANIFEST}")
    return location


def telemetry_json(audit: Column, metrics: Column) -> Column:
    """The nested record as JSON text."""
    return F.to_json(F.struct(audit.alias("audit_log"), metrics.alias("system_metrics")))


def feature_json(time_ms: Column, node: Column, features: Column, window_size: Column | None = None) -> Column:
    """A feature vector as JSON text, with the size of its window where given."""
    size = [] if window_size is None else [window_size.alias("window_size")]
    return F.to_json(F.struct(time_ms.alias("timestamp"), node.alias("node_name"), *size, features.alias("features")))


def stream_to(df: DataFrame, location: str, checkpoint: str, *, fmt: str = "parquet", interval: str | None = None, options: Mapping[str, str] | None = None) -> StreamingQuery:
    """Start an append stream. Without ``interval`` it processes what is available and ends.

    Progress and state live in ``checkpoint``; file sinks commit each batch once.
    With ``fmt='kafka'`` ``location`` is the topic and the whole row is sent as JSON.
    """
    options = dict(options or {})
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    if fmt == "kafka":
        df = df.select(F.to_json(F.struct("*")).alias("value"))
        options["topic"] = location
    else:
        options["path"] = location
    return (
        df.writeStream.format(fmt)
        .options(**options)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**trigger)
        .start()
    )
