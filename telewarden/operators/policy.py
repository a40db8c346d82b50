"""Severity and response rules as columns; an undefined rule is false."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telewarden import schemas
from telewarden.functions.ordered import chunk_window, frame_chunks, own_rows, with_position
from telewarden.functions.vectors import known

LOW, MEDIUM, HIGH, CRITICAL = (
    schemas.SEVERITY_LOW, schemas.SEVERITY_MEDIUM, schemas.SEVERITY_HIGH, schemas.SEVERITY_CRITICAL,
)
# Score limits per namespace and actions per role.
NAMESPACE_LIMITS = {"default": 0.70, "kube-system": 0.65}
ROLE_ACTIONS = {
    "admin": ["create", "update", "delete", "exec", "portforward"],
    "developer": ["get", "list", "describe", "logs"],
}
RUN_LENGTH = 3


def _rule(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _by_severity(score: Column, names: Sequence[str], otherwise: str) -> Column:
    """Names from critical down to low; ``otherwise`` for a missing score, too."""
    score = known(score)
    return F.coalesce(
        *[F.when(score >= bound, F.lit(name)) for bound, name in zip((CRITICAL, HIGH, MEDIUM, LOW), names)], F.lit(otherwise)
    )


def alert_level(score: Column) -> Column:
    return _by_severity(score, ("critical", "high", "medium", "low"), "none")


def recommend_action(score: Column) -> Column:
    return _by_severity(score, ("QUARANTINE", "ISOLATE", "MONITOR", "LOG"), "ALLOW")


def isolate(score: Column, confidence: Column) -> Column:
    return _rule((known(score) >= HIGH) & (known(confidence) >= 0.90))


def quarantine(score: Column, confidence: Column) -> Column:
    return _rule((known(score) >= CRITICAL) & (known(confidence) >= 0.95))


def namespace_allowed(namespace: Column, score: Column) -> Column:
    allowed = F.lit(False)
    for name, limit in NAMESPACE_LIMITS.items():
        allowed = allowed | ((namespace == name) & (known(score) < limit))
    return _rule(allowed)


def user_role(user_name: Column) -> Column:
    return F.when(user_name.isin(*ROLE_ACTIONS), user_name).otherwise(F.lit("system"))


def role_action_allowed(role: Column, action: Column) -> Column:
    plain = F.regexp_replace(action, "-", "")
    allowed = F.lit(False)
    for name, actions in ROLE_ACTIONS.items():
        allowed = allowed | ((role == name) & plain.isin(*actions))
    return _rule(allowed)


def business_hours(ts: Column) -> Column:
    return _rule(F.hour(ts).between(9, 17) & (F.weekday(ts) < 5))


def high_confidence(confidence: Column) -> Column:
    return _rule(known(confidence) >= 0.85)


def model_confidence(s_lstm: Column, s_if: Column, s_gnn: Column) -> Column:
    """1 minus the spread of the model scores; null if a score is missing."""
    scores = [known(s) for s in (s_lstm, s_if, s_gnn)]
    complete = scores[0].isNotNull() & scores[1].isNotNull() & scores[2].isNotNull()
    return F.when(complete, F.lit(1.0) - (F.greatest(*scores) - F.least(*scores)))


def consensus(threshold: float, *scores: Column) -> Column:
    agreed = F.lit(True)
    for s in scores:
        agreed = agreed & (known(s) >= threshold)
    return _rule(agreed)


def audit_required(score: Column) -> Column:
    return _rule(known(score) >= HIGH)


def violations(namespace_ok: Column, role_ok: Column, suspicious: Column) -> Column:
    """Names of the failed rules."""
    return F.array_compact(
        F.array(
            F.when(~namespace_ok, F.lit("invalid_action_in_namespace")),
            F.when(~role_ok, F.lit("unauthorized_user_action")),
            F.when(suspicious, F.lit("suspicious_activity_pattern")),
        )
    )


def recent_anomalies(df: DataFrame, anomalous: Column, *, keys: Sequence[str], order: Sequence[str], run: int = RUN_LENGTH) -> DataFrame:
    """Add ``suspicious``: this row and the ``run - 1`` before it of the same entity are all anomalous."""
    chunks = frame_chunks(df.withColumn("_hit", _rule(anomalous)), keys, order, order[0], run)
    frame = chunk_window(keys).rowsBetween(-(run - 1), Window.currentRow)
    return own_rows(chunks.withColumn("suspicious", F.count_if("_hit").over(frame) >= run)).drop("_hit", "pos")


def consecutive_anomalies(df: DataFrame, anomalous: Column, *, keys: Sequence[str], order: Sequence[str], run: int = RUN_LENGTH) -> DataFrame:
    """Runs of at least ``run`` consecutive anomalous rows per entity.

    Row position minus anomaly count is constant along a run, so runs are
    ordinary groups and even one that spans an entity's whole history is summed map-side.
    """
    hit = _rule(anomalous)
    placed = with_position(df, keys, order, order[0], running={"_hits": hit})
    return (
        placed.where(hit)
        .groupBy(*keys, (F.col("pos") - F.col("_hits")).alias("_run"))
        .agg(F.count(F.lit(1)).alias("run_length"), F.min(order[0]).alias("first_ts"), F.max(order[0]).alias("last_ts"))
        .where(F.col("run_length") >= run)
        .drop("_run")
    )


def compliance_metrics(df: DataFrame, *, score: str = "score", confidence: str = "confidence") -> DataFrame:
    s, c = known(F.col(score)), known(F.col(confidence))
    return df.agg(
        F.count_if((s >= LOW) & (s < MEDIUM)).alias("alerts_generated"),
        F.count_if(isolate(s, c)).alias("isolations_triggered"),
        F.count_if(quarantine(s, c)).alias("quarantines_activated"),
    )
