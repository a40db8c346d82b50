"""Parsing, enriching, routing and pairing of raw telemetry."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telewarden import schemas
from telewarden.functions.ordered import with_position
from telewarden.functions.skew import lookup_join
from telewarden.session import cut_lineage


def event_time(text: Column, default: Column) -> Column:
    """Epoch milliseconds or an ISO time, else ``default``."""
    ms = F.timestamp_millis(F.when(text.rlike(r"^-?\d{1,18}$"), text).try_cast("bigint"))
    iso = F.when(~text.rlike(r"^-?\d+$"), text).try_cast("timestamp")
    return F.coalesce(ms, iso, default.cast("timestamp"))


def parse_telemetry(values: DataFrame, *, value: str = "value", ingest_time: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """JSON text to typed telemetry with defaults; flat and nested records alike.

    Records that are not JSON objects come back with ``_corrupt`` set (see ``split_corrupt``). A record without a time has ``ingest_time``,
    by default the column of that name that brokers add; without either its time is null, never the wall clock.
    """
    given = ingest_time if ingest_time is not None else F.col("ingest_time") if "ingest_time" in values.columns else F.lit(None)
    now = given.cast("timestamp")
    parsed = values.select(
        *keep,
        F.col(value).alias("_raw"),
        now.alias("_now"),
        # Exploding one parsed record keeps later filters above the parser, so text is parsed once.
        F.explode(F.array(F.from_json(value, schemas.TELEMETRY_TEXT, {"columnNameOfCorruptRecord": "_corrupt"}))).alias("j"),
    )
    j, metrics, audit = F.col("j"), F.col("j.system_metrics"), F.col("j.audit_log")

    def text(name: str, nested: Column) -> Column:
        return F.coalesce(nested[name], j[name])

    def number(name: str, kind: str, default: Column) -> Column:
        return F.coalesce(text(name, metrics).try_cast("double").try_cast(kind), default)

    stamp = F.coalesce(metrics["timestamp"], audit["timestamp"], j["timestamp"])
    return parsed.select(
        *keep,
        F.coalesce(text("event_id", audit), F.lit("unknown")).alias("event_id"),
        event_time(stamp, F.col("_now")).alias("ts"),
        F.coalesce(text("node_name", metrics), F.lit("unknown")).alias("node_name"),
        F.coalesce(text("user_name", audit), F.lit("unknown")).alias("user_name"),
        F.coalesce(text("action", audit), F.lit("unknown")).alias("action"),
        number("cpu_usage", "double", F.lit(0.0)).alias("cpu_usage"),
        number("memory_usage", "double", F.lit(0.0)).alias("memory_usage"),
        number("process_count", "int", F.lit(0)).alias("process_count"),
        F.when(j.isNull() | j["_corrupt"].isNotNull(), F.coalesce(F.col("_raw"), F.lit(""))).alias("_corrupt"),
    )


def split_corrupt(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good records, and the raw text of bad ones."""
    good = parsed.where(F.col("_corrupt").isNull()).drop("_corrupt")
    return good, parsed.where(F.col("_corrupt").isNotNull()).select(F.col("_corrupt").alias("value"))


def flatten_telemetry(nested: DataFrame) -> DataFrame:
    """``audit_log`` and ``system_metrics`` structs side by side as flat columns."""
    audit = [f.name for f in nested.schema["audit_log"].dataType.fields if f.name != "timestamp"]
    metrics = [f.name for f in nested.schema["system_metrics"].dataType.fields if f.name != "timestamp"]
    rest = [c for c in nested.columns if c not in ("audit_log", "system_metrics")]
    return nested.select(
        *rest,
        F.coalesce(F.col("system_metrics.timestamp"), F.col("audit_log.timestamp")).alias("ts"),
        *[F.col(f"audit_log.{c}").alias(c) for c in audit],
        *[F.col(f"system_metrics.{c}").alias(c) for c in metrics],
    )


def parse_log_field(logs: DataFrame, schema, *, field: str = "log", into: str = "parsed") -> DataFrame:
    """Parse the JSON held in ``field``; the original stays."""
    return logs.withColumn(into, F.from_json(field, schema))


def merge_log(logs: DataFrame, schema, *, field: str = "log") -> DataFrame:
    """Lift the keys of the JSON in ``field`` to columns and drop the text."""
    return parse_log_field(logs, schema, field=field, into="_merged").select(*[c for c in logs.columns if c != field], "_merged.*")


def add_metadata(logs: DataFrame, *, hostname: Column, timestamp: Column) -> DataFrame:
    return logs.withColumns({"hostname": hostname, "timestamp": timestamp})


def tag_matches(tag: Column, pattern: str) -> Column:
    """Whether a tag matches a glob such as ``container.*``."""
    special = set(".^$+?{}[]|()\\")
    regex = "".join(".*" if ch == "*" else f"\\{ch}" if ch in special else ch for ch in pattern)
    return tag.rlike(f"^{regex}$")


def route(logs: DataFrame, patterns: Mapping[str, str]) -> DataFrame:
    """Add ``route``: the first name whose glob matches the tag; others are left out."""
    chosen = F.coalesce(*[F.when(tag_matches(F.col("tag"), glob), F.lit(name)) for name, glob in patterns.items()])
    return logs.withColumn("route", chosen).where(F.col("route").isNotNull())


def skip_long_lines(logs: DataFrame, limit: int, *, field: str = "log") -> DataFrame:
    return logs.where(F.length(field) <= limit)


def modulo_pair(audit: DataFrame, metrics: DataFrame, *, audit_order: Sequence[str], metric_order: Sequence[str]) -> DataFrame:
    """Audit row ``i`` beside metric row ``i % n``; columns of ``metrics`` must be distinct from ``audit``'s.

    Both orders start with a time column. Positions come from bucket totals, so
    no side is sorted in one task. The metric rows are stored once, as their count, their positions and the join all need them; few of them are broadcast,
    else slots that many audit rows share are salted.
    """
    metrics = cut_lineage(metrics, "metrics")
    left = with_position(audit, [], audit_order, audit_order[0], name="_i")
    right = cut_lineage(with_position(metrics, [], metric_order, metric_order[0], name="_slot"), "slots")
    n = metrics.count()
    return lookup_join(left.withColumn("_slot", F.col("_i") % F.lit(max(n, 1))), right, ["_slot"]).drop("_slot", "_i")


def enrich_metadata(records: DataFrame, pods: DataFrame, on: str = "node_name") -> DataFrame:
    """Left lookup of pod metadata, one row per pod; a stream on the left takes a plain join."""
    if records.isStreaming:
        return records.join(pods, on, "left")
    return lookup_join(records, pods, [on], "left")


def union_logs(*parts: DataFrame) -> DataFrame:
    """Concatenate by name; columns a part lacks are null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def sort_logs(logs: DataFrame, time_col: str = "timestamp", id_col: str = "event_id") -> DataFrame:
    return logs.orderBy(time_col, id_col)
