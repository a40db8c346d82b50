"""Tagging of audit logs by attack signature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def signature() -> Column:
    """The first matching signature, else ``none``."""
    c = F.col
    secret = c("resource").isin("secret", "secrets")
    rules: list[tuple[str, Column]] = [
        ("brute_force_auth", (c("status_code") == 401) & secret),
        ("privilege_escalation", (c("action") == "update") & (c("resource") == "rbac")),
        ("data_exfiltration", (c("response_time_ms") >= 5000) & (c("object_count") >= 1000)),
        ("malicious_deletion", (c("action") == "delete") & c("bulk_delete")),
        ("unauthorized_access", (c("status_code") == 403) & (c("resource") == "rbac") & (c("namespace") == "kube-system")),
        ("unusual_patterns", c("unusual_time") | c("frequency_anomaly")),
    ]
    return F.coalesce(*[F.when(hit, F.lit(name)) for name, hit in rules], F.lit("none"))


def tag_signatures(logs: DataFrame) -> DataFrame:
    """Add ``signature``; indicator columns a log lacks count as unset."""
    missing = {n: F.lit(False) for n in ("bulk_delete", "unusual_time", "frequency_anomaly") if n not in logs.columns}
    return logs.withColumns(missing).withColumn("signature", signature()).drop(*missing)
