"""Scans, sinks, parsing, routing and pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telewarden import schemas
from telewarden.operators import activity, ensemble, evaluation, features, signatures, telemetry
from telewarden.plans import views
from telewarden.plans.registry import over, query
from telewarden.session import cut_lineage, scratch_path
from telewarden.sources import readers, writers
from telewarden.streaming import delivery, jobs


def millis(c: str = "ts") -> Column:
    return F.unix_millis(F.col(c).cast("timestamp"))


def finish(df: DataFrame, spark: SparkSession, label: str, schema=None) -> DataFrame:
    """Run a stream over what is available into a parquet sink and read it back."""
    out = scratch_path(spark, label)
    writers.stream_to(df, out, scratch_path(spark, f"{label}-progress")).awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def _telemetry_values(spark: SparkSession, folder: str) -> DataFrame:
    """The telemetry view as JSON text, half of it flat and half nested."""
    t = views.telemetry(spark, folder)
    flat = F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id"), millis().alias("timestamp"), *t.columns[2:]))
    nested = writers.telemetry_json(
        F.struct(F.col("event_id").cast("string").alias("event_id"), "user_name", "action"),
        F.struct(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), "node_name", "cpu_usage", "memory_usage", "process_count"
        ),
    )
    return t.select("event_id", F.when(F.col("event_id") % 2 == 0, flat).otherwise(nested).alias("value"))


_PARSED = over(
    "v_telemetry",
    "select event_id, epoch_us(ts) // 1000 as ts_ms, node_name, user_name, action, cpu_usage, memory_usage, process_count from v_telemetry",
)


def _parsed_columns(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("event_id").cast("long").alias("event_id"), millis().alias("ts_ms"),
        "node_name", "user_name", "action", "cpu_usage", "memory_usage", "process_count",
    )


@query("scan_telemetry", _PARSED)
def scan_telemetry(spark: SparkSession, folder: str) -> DataFrame:
    topic = scratch_path(spark, "telemetry")
    _telemetry_values(spark, folder).select("value").write.text(topic)
    parsed = telemetry.parse_telemetry(readers.open_values(spark, topic, streaming=True))
    good, _ = telemetry.split_corrupt(parsed)
    return _parsed_columns(finish(good, spark, "scan-telemetry"))


@query("parse_telemetry", _PARSED)
def parse_telemetry(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed_columns(telemetry.split_corrupt(telemetry.parse_telemetry(_telemetry_values(spark, folder)))[0])


@query("flatten_telemetry", over(
    "v_telemetry v_audit",
    """select event_id, epoch_us(t.ts) // 1000 as ts_ms, a.user_name, a.action, a.resource, a.namespace, coalesce(a.status_code, -1) as status_code,
       node_name, cpu_usage, memory_usage, process_count from v_telemetry t join v_audit a using (event_id)""",
))
def flatten_telemetry(spark: SparkSession, folder: str) -> DataFrame:
    both = views.telemetry_with_audit(spark, folder)
    nested = both.select(
        "event_id",
        F.struct(F.col("ts").alias("timestamp"), "user_name", "action", "resource", "namespace", "status_code").alias("audit_log"),
        F.struct(F.col("ts").alias("timestamp"), "node_name", "cpu_usage", "memory_usage", "process_count").alias("system_metrics"),
    )
    return telemetry.flatten_telemetry(nested).withColumn("ts_ms", millis()).drop("ts").na.fill(-1, ["status_code"])


@query("telemetry_json", over(
    "v_telemetry v_audit",
    """select event_id, to_json({'audit_log': {'event_id': event_id, 'user_name': a.user_name, 'action': a.action, 'resource': a.resource,
       'namespace': a.namespace}, 'system_metrics': {'timestamp': epoch_us(t.ts) // 1000, 'node_name': node_name, 'cpu_usage': cpu_usage,
       'memory_usage': memory_usage, 'process_count': process_count}}) as value from v_telemetry t join v_audit a using (event_id)""",
))
def telemetry_json(spark: SparkSession, folder: str) -> DataFrame:
    both = views.telemetry_with_audit(spark, folder)
    audit = F.struct("event_id", "user_name", "action", "resource", "namespace")
    metrics = F.struct(millis().alias("timestamp"), "node_name", "cpu_usage", "memory_usage", "process_count")
    return both.select("event_id", writers.telemetry_json(audit, metrics).alias("value"))


@query("feature_json", over(
    "v_features",
    "select event_id, epoch_us(ts) // 1000 as ts_ms, node_name, "
    + ", ".join(f"f{i}" for i in range(8)) + " from v_features",
))
def feature_json(spark: SparkSession, folder: str) -> DataFrame:
    """Written as JSON text and read back."""
    v = features.feature_vector(views.telemetry(spark, folder))
    text = v.select("event_id", writers.feature_json(millis(), F.col("node_name"), F.col("features")).alias("value"))
    back = text.select("event_id", F.from_json("value", "timestamp bigint, node_name string, features array<double>").alias("r"))
    return back.select(
        "event_id", F.col("r.timestamp").alias("ts_ms"), F.col("r.node_name").alias("node_name"),
        *[F.col("r.features")[i].alias(f"f{i}") for i in range(8)],
    )


_NULLABLE = ["status_code", "response_time_ms", "object_count", "failed_attempts"]  # nulls shown as -1
_AUDIT = over(
    "v_audit",
    """select event_id, epoch_us(ts) // 1000 as ts_ms, user_name, action, resource, namespace, coalesce(status_code, -1) as status_code,
       coalesce(response_time_ms, -1) as response_time_ms, coalesce(object_count, -1) as object_count,
       coalesce(failed_attempts, -1) as failed_attempts, bulk_delete, is_anomaly from v_audit""",
)


@query("jsonl_roundtrip", _AUDIT)
def jsonl_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    logs = views.audit(spark, folder).withColumn("ts_ms", millis()).drop("ts")
    location = writers.write_json_lines(logs, scratch_path(spark, "audit-jsonl"))
    return readers.open_records(spark, location, logs.schema, fmt="json").na.fill(-1, _NULLABLE)


@query("scan_csv", _AUDIT)
def scan_csv(spark: SparkSession, folder: str) -> DataFrame:
    logs = views.audit(spark, folder).withColumn("ts_ms", millis()).drop("ts")
    location = writers.write_csv_table(logs, scratch_path(spark, "audit-csv"))
    return readers.read_csv_table(spark, location, logs.schema).na.fill(-1, _NULLABLE)


_MATRIX = over("v_telemetry", "select event_id, round(cpu_usage, 6) as c0, round(memory_usage, 6) as c1, cast(process_count as double) as c2 from v_telemetry")


def _matrix_file(spark: SparkSession, folder: str) -> str:
    return writers.write_feature_csv(
        views.telemetry(spark, folder), scratch_path(spark, "matrix"), ["cpu_usage", "memory_usage", "process_count"], ids=["event_id"]
    )


@query("scan_matrix", _MATRIX)
def scan_matrix(spark: SparkSession, folder: str) -> DataFrame:
    m = readers.read_csv_matrix(spark, _matrix_file(spark, folder), 3, ids=["event_id"])
    return m.select("event_id", *[F.col("features")[i].alias(f"c{i}") for i in range(3)])


@query("csv_roundtrip", over(
    "v_telemetry",
    """select event_id, printf('%.6f', cpu_usage) as c0, printf('%.6f', memory_usage) as c1, printf('%.6f', cast(process_count as double)) as c2
       from v_telemetry""",
))
def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The fixed-point text as it stands in the file."""
    return spark.read.schema("event_id bigint, c0 string, c1 string, c2 string").csv(_matrix_file(spark, folder))


_LABELED = over("v_fused", "select event_id as row_id, y_true, score from v_fused")


@query("scan_scores", _LABELED)
def scan_scores(spark: SparkSession, folder: str) -> DataFrame:
    fused = ensemble.fuse_scores(views.scored(spark, folder))
    scores, labels = scratch_path(spark, "scores"), scratch_path(spark, "labels")
    fused.select("event_id", "score").write.csv(scores)
    fused.select("event_id", F.col("y_true").cast("double")).write.csv(labels)
    return evaluation.zip_labels(spark.read.schema("row_id bigint, score double").csv(scores), readers.read_labels(spark, labels))


@query("zip_labels", _LABELED)
def zip_labels(spark: SparkSession, folder: str) -> DataFrame:
    fused = ensemble.fuse_scores(views.scored(spark, folder)).withColumnRenamed("event_id", "row_id")
    return evaluation.zip_labels(fused.select("row_id", "score"), fused.select("row_id", "y_true"))


@query("scan_logs", over("v_logs", "select tag, log from v_logs"))
def scan_logs(spark: SparkSession, folder: str) -> DataFrame:
    location = scratch_path(spark, "logs")
    views.logs(spark, folder).select("tag", F.col("log").alias("value")).write.partitionBy("tag").text(location)
    return readers.read_logs(spark, location)


@query("skip_long_lines", over("v_logs", "select event_id, tag, log from v_logs where length(log) <= 8"))
def skip_long_lines(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.skip_long_lines(views.logs(spark, folder), 8).drop("ts")


ROUTES = {"audit": "kube.audit", "node": "kubelet", "workload": "container.*"}


@query("route_by_tag", over(
    "v_logs",
    r"""select event_id, tag, case when regexp_matches(tag, '^kube\.audit$') then 'audit' when regexp_matches(tag, '^kubelet$') then 'node'
       when regexp_matches(tag, '^container\..*$') then 'workload' end as route from v_logs""",
))
def route_by_tag(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.route(views.logs(spark, folder), ROUTES).select("event_id", "tag", "route")


@query("parse_log_field", over("v_logs", "select event_id, log, cast(log ->> 'k' as int) as k from v_logs"))
def parse_log_field(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.parse_log_field(views.logs(spark, folder), "k int").select("event_id", "log", F.col("parsed.k").alias("k"))


@query("merge_log", over("v_logs", "select event_id, tag, cast(log ->> 'k' as int) as k from v_logs"))
def merge_log(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.merge_log(views.logs(spark, folder), "k int").drop("ts")


@query("add_metadata", over("v_logs", "select event_id, tag, log, 'collector-1' as hostname, epoch_us(ts) // 1000 as timestamp from v_logs"))
def add_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.add_metadata(views.logs(spark, folder), hostname=F.lit("collector-1"), timestamp=millis()).drop("ts")


@query("enrich_metadata", over("v_telemetry v_pods", "select event_id, node_name, r_name from v_telemetry left join v_pods using (node_name)"))
def enrich_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.enrich_metadata(views.telemetry(spark, folder).select("event_id", "node_name"), views.pods(spark, folder))


@query("modulo_pair", over(
    "v_audit v_telemetry",
    """select event_id, node_name, n_events, round(cpu, 4) as cpu
       from (select event_id, (row_number() over (order by ts, event_id) - 1) % (select count(*) from metrics) as slot from v_audit) a
       join (select *, row_number() over (order by seen, node_name) - 1 as slot from metrics) m using (slot)""",
    metrics="select node_name, max(ts) as seen, avg(cpu_usage) as cpu, count(*) as n_events from v_telemetry group by node_name",
))
def modulo_pair(spark: SparkSession, folder: str) -> DataFrame:
    metrics = views.telemetry(spark, folder).groupBy("node_name").agg(
        F.max("ts").alias("seen"), F.avg("cpu_usage").alias("cpu"), F.count(F.lit(1)).alias("n_events")
    )
    logs = views.audit(spark, folder).select("event_id", "ts")
    paired = telemetry.modulo_pair(logs, metrics, audit_order=["ts", "event_id"], metric_order=["seen", "node_name"])
    return paired.select("event_id", "node_name", "n_events", F.round("cpu", 4).alias("cpu"))


@query("union_logs", over(
    "v_audit",
    """select event_id, user_name, action, cast(null as varchar) as anomaly_type from v_audit where not is_anomaly
       union all select event_id, user_name, action, 'tagged' as anomaly_type from v_audit where is_anomaly""",
))
def union_logs(spark: SparkSession, folder: str) -> DataFrame:
    logs = views.audit(spark, folder).select("event_id", "user_name", "action", "is_anomaly")
    normal = logs.where("not is_anomaly").drop("is_anomaly")
    odd = logs.where("is_anomaly").drop("is_anomaly").withColumn("anomaly_type", F.lit("tagged"))
    return telemetry.union_logs(normal, odd)


@query("union_inputs", over("v_logs", "select event_id, tag, log from v_logs"))
def union_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Three tagged streams merged into one."""
    routed = telemetry.route(views.logs(spark, folder), ROUTES).select("event_id", "tag", "log", "route")
    location = scratch_path(spark, "inputs")
    routed.write.partitionBy("route").parquet(location)
    schema = routed.drop("route").schema
    inputs = [readers.open_records(spark, f"{location}/route={name}", schema, streaming=True) for name in ROUTES]
    return finish(jobs.merge_inputs(*inputs), spark, "union-inputs")


@query("sort_logs", over("v_audit", "select event_id, epoch_us(ts) // 1000 as ts_ms, user_name from v_audit order by ts, event_id"))
def sort_logs(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.sort_logs(views.audit(spark, folder), "ts").select("event_id", millis().alias("ts_ms"), "user_name")


@query("derived_features", over(
    "v_telemetry",
    """select event_id, cpu_usage * memory_usage as f3, cpu_usage / (process_count + 1) as f4,
       memory_usage / (process_count + 1) as f5 from v_telemetry""",
))
def derived_features(spark: SparkSession, folder: str) -> DataFrame:
    wide = features.with_features(views.telemetry(spark, folder))
    return wide.select("event_id", "f3", "f4", "f5")


@query("hash_buckets", over("v_features", "select event_id, cast(f6 as int) as action_code, cast(f7 as int) as user_code from v_features"))
def hash_buckets(spark: SparkSession, folder: str) -> DataFrame:
    t = views.telemetry(spark, folder)
    return t.select(
        "event_id",
        features.hash_code(F.col("action"), schemas.ACTION_CODES).alias("action_code"),
        features.hash_code(F.col("user_name"), schemas.USER_CODES).alias("user_code"),
    )


@query("feature_vector", over(
    "v_features",
    "select event_id, " + ", ".join(f"f{i}" for i in range(8)) + ", 73 as width, 0e0 as padding from v_features",
))
def feature_vector(spark: SparkSession, folder: str) -> DataFrame:
    v = features.feature_vector(views.telemetry(spark, folder), pad_to=schemas.VECTOR_WIDTH)
    rest = F.aggregate(F.slice("features", 9, schemas.VECTOR_WIDTH), F.lit(0.0), lambda s, x: s + F.abs(x))
    return v.select(
        "event_id", *[F.col("features")[i].alias(f"f{i}") for i in range(8)],
        F.size("features").alias("width"), rest.alias("padding"),
    )


@query("feature_vector_wide", over(
    "v_features v_audit",
    """select event_id, 73 as width, cast(event_id % 1000 as double) as f8, cast(event_id % 777 as double) as f9, cast(event_id % 100 as double) / 100 as f10,
       cast(hour(f.ts) as double) as f11, cast(isodow(f.ts) - 1 as double) as f12, cast(status_code as double) as f13 from v_features f join v_audit a using (event_id)""",
))
def feature_vector_wide(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of 73 slots with all declared ones live, for telemetry that carries network, disk and status columns."""
    e = F.col("event_id")
    wide = views.telemetry_with_audit(spark, folder).withColumns({"network_in": e % 1000, "network_out": e % 777, "disk_usage": (e % 100).cast("double") / 100})
    v = features.feature_vector(wide, (*features.DEFAULT_FEATURES, *features.OPTIONAL_FEATURES), pad_to=schemas.VECTOR_WIDTH)
    return v.select("event_id", F.size("features").alias("width"), *[F.col("features")[i].alias(f"f{i}") for i in range(8, 14)])


def _index_sql(values: list[str], column: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"cast(greatest(coalesce(list_position([{listed}], {column}), 0) - 1, 0) as double)"


@query("audit_features", over(
    "v_audit",
    f"""select event_id, {_index_sql(schemas.AUDIT_ACTIONS, 'action')} as a0, {_index_sql(schemas.AUDIT_RESOURCES, 'resource')} as a1,
       coalesce(status_code, 200) / 100e0 as a2, round(coalesce(response_time_ms, 0) / 1000e0, 6) as a3, coalesce(object_count, 1) / 100e0 as a4,
       0e0 as a5, coalesce(failed_attempts, 0) / 10e0 as a6, case when bulk_delete then 1e0 else 0e0 end as a7 from v_audit""",
))
def audit_features(spark: SparkSession, folder: str) -> DataFrame:
    encoded = features.audit_features(views.audit(spark, folder))
    return encoded.select("event_id", *[F.round(f"a{i}", 6).alias(f"a{i}") for i in range(8)])


@query("audit_signatures", over(
    "v_audit",
    """select event_id, case when status_code = 401 and resource in ('secret', 'secrets') then 'brute_force_auth'
       when action = 'update' and resource = 'rbac' then 'privilege_escalation'
       when response_time_ms >= 5000 and object_count >= 1000 then 'data_exfiltration'
       when action = 'delete' and bulk_delete then 'malicious_deletion'
       when status_code = 403 and resource = 'rbac' and namespace = 'kube-system' then 'unauthorized_access'
       else 'none' end as signature from v_audit""",
))
def audit_signatures(spark: SparkSession, folder: str) -> DataFrame:
    return signatures.tag_signatures(views.audit(spark, folder)).select("event_id", "signature")


_ACTIVITY = {
    "hourly": "select user_name, cast(floor(epoch_us(ts) / 3600e6) as bigint) as hour, count(*) as events from v_audit group by 1, 2",
    "weighed": f"select *, events * pow(2e0, (hour - (select min(hour) from hourly)) / {activity.HALF_LIFE_HOURS}e0) as w from hourly",
    "summed": f"""select *, sum(w) over (partition by user_name order by hour range between {activity.HISTORY_HOURS} preceding and 1 preceding) as past,
        sum(w) over (partition by user_name, hour % 24 order by hour range between {activity.HISTORY_HOURS} preceding and 1 preceding) as same,
        least(hour - min(hour) over (partition by user_name), {activity.HISTORY_HOURS}) as n from weighed""",
    "measured": f"""select user_name, hour, events, case when n >= {activity.LEAST_HOURS} then coalesce(past * events / w, 0e0)
            / list_sum([pow(2e0, -i / {activity.HALF_LIFE_HOURS}e0) for i in range(1, n + 1)]) end as expected,
        case when n >= {activity.LEAST_HOURS} then coalesce(same, 0e0) / past end as hour_share from summed""",
    "activity": f"""select *, coalesce(events >= {activity.LEAST_EVENTS} and events > expected * {activity.MOST_RATE}, false) as frequency_anomaly,
        coalesce(hour_share < {activity.LEAST_SHARE}, false) as unusual_time from measured""",
}


@query("activity_baseline", over(
    "v_audit", "select user_name, hour, events, round(expected, 6) as expected, round(hour_share, 6) as hour_share, frequency_anomaly, unusual_time from activity", **_ACTIVITY
))
def activity_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """Expected events and share of the hour for every user and hour, and what departs from them."""
    found = activity.activity_baseline(activity.hourly_activity(views.audit(spark, folder)))
    return found.withColumns({c: F.round(c, 6) for c in ("expected", "hour_share")})


@query("audit_signatures_all", over(
    "v_audit",
    """select event_id, case when status_code = 401 and resource in ('secret', 'secrets') then 'brute_force_auth'
       when action = 'update' and resource = 'rbac' then 'privilege_escalation'
       when response_time_ms >= 5000 and object_count >= 1000 then 'data_exfiltration'
       when action = 'delete' and bulk_delete then 'malicious_deletion'
       when status_code = 403 and resource = 'rbac' and namespace = 'kube-system' then 'unauthorized_access'
       when unusual_time or frequency_anomaly then 'unusual_patterns'
       else 'none' end as signature from v_audit join activity a on a.user_name = v_audit.user_name and a.hour = floor(epoch_us(ts) / 3600e6)""",
    **_ACTIVITY,
))
def audit_signatures_all(spark: SparkSession, folder: str) -> DataFrame:
    """All six signatures; the inputs of the last are taken from the users' own history."""
    logs = views.audit(spark, folder)
    baseline = cut_lineage(activity.activity_baseline(activity.hourly_activity(logs)), "activity")
    return signatures.tag_signatures(activity.flag_activity(logs, baseline)).select("event_id", "signature")


_ROUTED = over(
    "v_telemetry",
    """select event_id, coalesce(route, 'good') as route from (
         select event_id, case when event_id % 50 = 3 then 'corrupt' when ms < (select max(ms) from parts b where b.part < parts.part
             and b.event_id % 50 <> 3) - 120000 then 'late' else 'good' end as route from parts) r""",
    parts="select event_id, epoch_us(ts) // 1000 as ms, event_id % 3 as part from v_telemetry",
)


@query("route_telemetry", _ROUTED)
def route_telemetry(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of three batches in exactly one of good, late and corrupt; each fiftieth is cut short."""
    topic, out = scratch_path(spark, "telemetry"), scratch_path(spark, "routed")
    values = _telemetry_values(spark, folder)
    whole = F.col("event_id") % 50 != 3
    text = values.select("event_id", F.when(whole, F.col("value")).otherwise(F.concat(F.col("event_id").cast("string"), F.lit("{"))).alias("value"))
    for part in range(3):  # a batch each
        text.where(F.col("event_id") % 3 == part).select("value").coalesce(1).write.mode("append").text(topic)
    parsed = telemetry.parse_telemetry(readers.open_values(spark, topic, streaming=True, options={"maxFilesPerTrigger": "1"}))
    delivery.route_records(parsed, out, scratch_path(spark, "routed-progress")).awaitTermination()
    found = delivery.read_delivered(spark, out, T.StructType([*parsed.schema.fields, T.StructField("route", T.StringType())]))
    number = F.when(F.col("route") == delivery.CORRUPT, F.regexp_extract("_corrupt", r"^(\d+)", 1)).otherwise(F.col("event_id"))
    return found.select(number.cast("long").alias("event_id"), "route")
