"""Per-event features as columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telewarden import schemas
from telewarden.functions.text_codes import hash_code


@dataclass(frozen=True)
class Feature:
    """One declared slot of the feature vector."""

    name: str
    value: Callable[[], Column]


def _per_process(name: str) -> Callable[[], Column]:
    return lambda: F.try_divide(F.col(name), F.col("process_count") + F.lit(1))


# The eight declared slots in vector order.
DEFAULT_FEATURES: tuple[Feature, ...] = (
    Feature("cpu_usage", lambda: F.col("cpu_usage")),
    Feature("memory_usage", lambda: F.col("memory_usage")),
    Feature("process_count", lambda: F.col("process_count").cast("double")),
    Feature("cpu_x_memory", lambda: F.col("cpu_usage") * F.col("memory_usage")),
    Feature("cpu_per_process", _per_process("cpu_usage")),
    Feature("memory_per_process", _per_process("memory_usage")),
    Feature("action_code", lambda: hash_code(F.col("action"), schemas.ACTION_CODES).cast("double")),
    Feature("user_code", lambda: hash_code(F.col("user_name"), schemas.USER_CODES).cast("double")),
)

# Further slots for inputs that carry the columns.
OPTIONAL_FEATURES: tuple[Feature, ...] = (
    Feature("network_in", lambda: F.col("network_in").cast("double")),
    Feature("network_out", lambda: F.col("network_out").cast("double")),
    Feature("disk_usage", lambda: F.col("disk_usage")),
    Feature("hour", lambda: F.hour("ts").cast("double")),
    Feature("weekday", lambda: F.weekday("ts").cast("double")),
    Feature("status_code", lambda: F.col("status_code").cast("double")),
)


def with_features(df: DataFrame, spec: Sequence[Feature] = DEFAULT_FEATURES) -> DataFrame:
    """Add one column ``f<i>`` per declared slot."""
    return df.withColumns({f"f{i}": f.value() for i, f in enumerate(spec)})


def feature_vector(df: DataFrame, spec: Sequence[Feature] = DEFAULT_FEATURES, *, pad_to: int | None = None) -> DataFrame:
    """Add ``features array<double>``; ``pad_to`` fills undeclared slots with 0."""
    slots = [f.value() for f in spec]
    vector = F.array(*slots)
    if pad_to is not None and pad_to > len(slots):
        vector = F.concat(vector, F.array_repeat(F.lit(0.0), pad_to - len(slots)))
    return df.withColumn("features", vector)


def _index_in(values: Sequence[str], c: Column) -> Column:
    listed = F.array(*[F.lit(v) for v in values])
    return F.greatest(F.coalesce(F.array_position(listed, c), F.lit(0)) - 1, F.lit(0)).cast("double")


def audit_features(logs: DataFrame, *, include_label: bool = False) -> DataFrame:
    """Encode audit logs in slots ``a0..a7``.

    Slot 5 would be the label itself, so it stays 0 unless asked for.
    """
    failed = F.coalesce(F.col("failed_attempts"), F.lit(0))
    return logs.withColumns(
        {
            "a0": _index_in(schemas.AUDIT_ACTIONS, F.col("action")),
            "a1": _index_in(schemas.AUDIT_RESOURCES, F.col("resource")),
            "a2": F.coalesce(F.col("status_code"), F.lit(200)) / F.lit(100.0),
            "a3": F.coalesce(F.col("response_time_ms"), F.lit(0)) / F.lit(1000.0),
            "a4": F.coalesce(F.col("object_count"), F.lit(1)) / F.lit(100.0),
            "a5": F.when(F.col("is_anomaly"), 1.0).otherwise(0.0) if include_label else F.lit(0.0),
            "a6": failed / F.lit(10.0),
            "a7": F.when(F.col("bulk_delete"), 1.0).otherwise(0.0),
        }
    )
