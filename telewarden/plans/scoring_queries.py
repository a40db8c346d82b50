"""Fusion, policy rules and evaluation over scored telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telewarden.operators import ensemble, evaluation, policy
from telewarden.plans import views
from telewarden.plans.registry import grid, grid_sql, over, query
from telewarden.session import scratch_path
from telewarden.sources import writers


def fused(spark: SparkSession, folder: str) -> DataFrame:
    return ensemble.fuse_scores(views.scored(spark, folder))


def rounded_all(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---- scores

@query("fuse_scores", over("v_fused", "select event_id, round(score, 6) as score from v_fused"))
def fuse_scores(spark: SparkSession, folder: str) -> DataFrame:
    return rounded_all(fused(spark, folder).select("event_id", "score"))


@query("detect", over("v_fused", "select event_id, round(score, 6) as score from v_fused where score >= 0.85e0"))
def detect(spark: SparkSession, folder: str) -> DataFrame:
    return rounded_all(ensemble.detect(fused(spark, folder)).where("is_anomaly").select("event_id", "score"))


@query("align_scores", over("v_scored", "select event_id, s_lstm, s_if, s_gnn from v_scored"))
def align_scores(spark: SparkSession, folder: str) -> DataFrame:
    parts = [views.scored(spark, folder).select("event_id", c) for c in ("s_lstm", "s_if", "s_gnn")]
    return ensemble.align_scores(*parts, on=["event_id"])


@query("minmax_scores", over(
    "v_telemetry",
    """select event_id, round((cpu_usage - lo) / (hi - lo), 6) as s_lstm, round((mhi - memory_usage) / (mhi - mlo), 6) as s_if
       from v_telemetry, (select min(cpu_usage) as lo, max(cpu_usage) as hi, min(memory_usage) as mlo, max(memory_usage) as mhi from v_telemetry) b""",
))
def minmax_scores(spark: SparkSession, folder: str) -> DataFrame:
    t = views.telemetry(spark, folder)
    both = ensemble.minmax_score(ensemble.minmax_score(t, "cpu_usage", "s_lstm"), "memory_usage", "s_if", invert=True)
    return rounded_all(both.select("event_id", "s_lstm", "s_if"))


@query("score_summary", over(
    "v_fused",
    """select count(*) as samples, count(*) filter (where score >= 0.85e0) as anomalies, count(*) filter (where score < 0.85e0) as normals, round(min(score), 6) as min,
       round(max(score), 6) as max, round(avg(score), 6) as mean, round(stddev_pop(score), 6) as std from v_fused""",
))
def score_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded_all(ensemble.score_summary(fused(spark, folder)))


@query("head_scores", over("v_fused", "select event_id, round(score, 6) as score from v_fused order by event_id limit 100"))
def head_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The first rows are the feature: a score check on the head of the table."""
    from telewarden.operators.sequences import head_rows

    return rounded_all(head_rows(fused(spark, folder).select("event_id", "score"), ["event_id"]))


@query("explain", over(
    "v_fused",
    """select event_id, s_lstm, s_if, s_gnn, 0.47e0 as lstm_weight, 0.28e0 as if_weight, 0.25e0 as gnn_weight,
       0.47e0 * s_lstm as lstm_contribution, 0.28e0 * s_if as if_contribution, 0.25e0 * s_gnn as gnn_contribution, score, score >= 0.85e0 as is_anomaly,
       case greatest(0.47e0 * s_lstm, 0.28e0 * s_if, 0.25e0 * s_gnn) when 0.47e0 * s_lstm then 'lstm' when 0.28e0 * s_if then 'if' else 'gnn' end as top_model
       from v_fused""",
))
def explain(spark: SparkSession, folder: str) -> DataFrame:
    return ensemble.explain(views.scored(spark, folder)).drop("ts", "node_name", "y_true")


# ---- missing scores, as NaN and as null

def _gappy(spark: SparkSession, folder: str) -> DataFrame:
    return ensemble.detect(ensemble.fuse_scores(views.gappy_scored(spark, folder)))


@query("fuse_scores_missing", over(
    "v_gappy_fused",
    f"""select event_id, {grid_sql("score", 6)} as score, score >= 0.85e0 as is_anomaly, {grid_sql("weighted", 6)} as weighted,
       concat_ws(',', case when s_lstm is null then 'lstm' end, case when s_if is null then 'isolation_forest' end) as missing_models from v_gappy_fused""",
))
def fuse_scores_missing(spark: SparkSession, folder: str) -> DataFrame:
    both = ensemble.fuse_scores(_gappy(spark, folder), into="weighted", allow_missing=True)
    snapped = [grid(F.col(c), 6).alias(c) for c in ("score", "weighted")]
    return both.select("event_id", *snapped, "is_anomaly", F.concat_ws(",", "missing_models").alias("missing_models"))


@query("score_summary_missing", over(
    "v_gappy_fused",
    """select count(*) as samples, count(*) filter (where score >= 0.85e0) as anomalies, count(*) filter (where score < 0.85e0) as normals, round(min(score), 6) as min,
       round(max(score), 6) as max, round(avg(score), 6) as mean, round(stddev_pop(score), 6) as std from v_gappy_fused""",
))
def score_summary_missing(spark: SparkSession, folder: str) -> DataFrame:
    return rounded_all(ensemble.score_summary(_gappy(spark, folder)))


@query("minmax_scores_missing", over(
    "v_gappy_scored",
    """select event_id, round((s_lstm - lo) / (hi - lo), 6) as s_lstm, round((hif - s_if) / (hif - lif), 6) as s_if
       from v_gappy_scored, (select min(s_lstm) as lo, max(s_lstm) as hi, min(s_if) as lif, max(s_if) as hif from v_gappy_scored) b""",
))
def minmax_scores_missing(spark: SparkSession, folder: str) -> DataFrame:
    t = views.gappy_scored(spark, folder)
    both = ensemble.minmax_score(ensemble.minmax_score(t, "s_lstm", "s_lstm"), "s_if", "s_if", invert=True)
    return rounded_all(both.select("event_id", "s_lstm", "s_if"))


# ---- policy

ALERT_SQL = """case when score >= 0.95e0 then 'critical' when score >= 0.85e0 then 'high' when score >= 0.75e0 then 'medium'
    when score >= 0.50e0 then 'low' else 'none' end"""
ACTION_SQL = """case when score >= 0.95e0 then 'QUARANTINE' when score >= 0.85e0 then 'ISOLATE' when score >= 0.75e0 then 'MONITOR'
    when score >= 0.50e0 then 'LOG' else 'ALLOW' end"""
_NAMESPACE = "((namespace = 'default' and score < 0.70e0) or (namespace = 'kube-system' and score < 0.65e0))"
_ROLE = """((user_role = 'admin' and replace(action, '-', '') in ('create', 'update', 'delete', 'exec', 'portforward'))
    or (user_role = 'developer' and replace(action, '-', '') in ('get', 'list', 'describe', 'logs')))"""


def _rule_query(name: str, sql: str, build) -> None:
    @query(name, over("v_policy", f"select event_id, {sql} as outcome from v_policy"))
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return views.policy_input(spark, folder).select("event_id", build().alias("outcome"))


_rule_query("alert_level", ALERT_SQL, lambda: policy.alert_level(F.col("score")))
_rule_query("recommend_action", ACTION_SQL, lambda: policy.recommend_action(F.col("score")))
_rule_query("isolation_rule", "(score >= 0.85e0 and confidence >= 0.90e0)", lambda: policy.isolate(F.col("score"), F.col("confidence")))
_rule_query("quarantine_rule", "(score >= 0.95e0 and confidence >= 0.95e0)", lambda: policy.quarantine(F.col("score"), F.col("confidence")))
_rule_query("namespace_gate", _NAMESPACE, lambda: policy.namespace_allowed(F.col("namespace"), F.col("score")))
_rule_query("role_action_gate", _ROLE, lambda: policy.role_action_allowed(F.col("user_role"), F.col("action")))
_rule_query("business_hours", "(hour(ts) between 9 and 17 and isodow(ts) < 6)", lambda: policy.business_hours(F.col("ts")))
_rule_query("high_confidence", "(confidence >= 0.85e0)", lambda: policy.high_confidence(F.col("confidence")))
_rule_query(
    "ensemble_consensus", "(s_lstm >= 0.5e0 and s_if >= 0.5e0 and s_gnn >= 0.5e0)",
    lambda: policy.consensus(0.5, F.col("s_lstm"), F.col("s_if"), F.col("s_gnn")),
)
_rule_query("audit_required", "(score >= 0.85e0)", lambda: policy.audit_required(F.col("score")))


@query("policy_missing", over(
    "v_gappy_fused",
    f"""select event_id, {ALERT_SQL} as alert_level, {ACTION_SQL} as action, coalesce(s_lstm >= 0.5e0 and s_if >= 0.5e0 and s_gnn >= 0.5e0, false) as consensus,
        coalesce(score >= 0.85e0, false) as audited, coalesce(score >= 0.85e0 and confidence >= 0.90e0, false) as isolated,
        coalesce(confidence >= 0.85e0, false) as confident from (select *, case when score is not null then
        1e0 - (greatest(s_lstm, s_if, s_gnn) - least(s_lstm, s_if, s_gnn)) end as confidence from v_gappy_fused) c""",
))
def policy_missing(spark: SparkSession, folder: str) -> DataFrame:
    """Levels, actions and rules over records that lack a score: no rule holds and nothing is done."""
    raw = F.col("s_lstm") * 0.47 + F.col("s_if") * 0.28 + F.col("s_gnn") * 0.25  # NaN where a part is
    judged = views.gappy_scored(spark, folder).withColumn("raw", raw)
    confidence = policy.model_confidence(F.col("s_lstm"), F.col("s_if"), F.col("s_gnn"))
    return judged.select(
        "event_id", policy.alert_level(F.col("raw")).alias("alert_level"), policy.recommend_action(F.col("raw")).alias("action"),
        policy.consensus(0.5, F.col("s_lstm"), F.col("s_if"), F.col("s_gnn")).alias("consensus"), policy.audit_required(F.col("raw")).alias("audited"),
        policy.isolate(F.col("raw"), confidence).alias("isolated"), policy.high_confidence(confidence).alias("confident"),
    )


@query("policy_violations", over(
    "v_policy",
    f"""select event_id, concat_ws(',', case when not {_NAMESPACE} then 'invalid_action_in_namespace' end,
        case when not {_ROLE} then 'unauthorized_user_action' end,
        case when hits >= 3 then 'suspicious_activity_pattern' end) as violations
        from (select *, count(*) filter (where score >= 0.5e0) over (partition by node_name order by ts, event_id rows between 2 preceding and current row) as hits
              from v_policy) p""",
))
def policy_violations(spark: SparkSession, folder: str) -> DataFrame:
    judged = policy.recent_anomalies(
        views.policy_input(spark, folder), F.col("score") >= 0.5, keys=["node_name"], order=["ts", "event_id"]
    )
    broken = policy.violations(
        policy.namespace_allowed(F.col("namespace"), F.col("score")),
        policy.role_action_allowed(F.col("user_role"), F.col("action")),
        F.col("suspicious"),
    )
    return judged.select("event_id", F.concat_ws(",", broken).alias("violations"))


@query("consecutive_anomalies", over(
    "v_fused",
    """select node_name, count(*) as run_length, epoch_us(min(ts)) // 1000 as first_ms, epoch_us(max(ts)) // 1000 as last_ms
       from (select *, row_number() over (partition by node_name order by ts, event_id)
             - row_number() over (partition by node_name, score >= 0.5e0 order by ts, event_id) as island from v_fused) r
       where score >= 0.5e0 group by node_name, island having count(*) >= 3""",
))
def consecutive_anomalies(spark: SparkSession, folder: str) -> DataFrame:
    runs = policy.consecutive_anomalies(fused(spark, folder), F.col("score") >= 0.5, keys=["node_name"], order=["ts", "event_id"])
    ms = {f"{n}_ms": F.unix_millis(F.col(f"{n}_ts").cast("timestamp")) for n in ("first", "last")}
    return runs.withColumns(ms).drop("first_ts", "last_ts")


@query("compliance_metrics", over(
    "v_fused",
    """select count(*) filter (where score >= 0.50e0 and score < 0.75e0) as alerts_generated,
       count(*) filter (where score >= 0.85e0 and confidence >= 0.90e0) as isolations_triggered,
       count(*) filter (where score >= 0.95e0 and confidence >= 0.95e0) as quarantines_activated from v_fused""",
))
def compliance_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return policy.compliance_metrics(views.policy_input(spark, folder))


# ---- evaluation

_CONFUSION = """select count(*) filter (where score >= {t} and y_true = 1) as tp, count(*) filter (where score >= {t} and y_true = 0) as fp,
    count(*) filter (where score < {t} and y_true = 1) as fn, count(*) filter (where score < {t} and y_true = 0) as tn from v_fused"""
_RATES = """round((tp + tn) / cast(tp + fp + fn + tn as double), 6) as accuracy,
    round(case when tp + fp > 0 then tp / cast(tp + fp as double) else 0e0 end, 6) as precision,
    round(case when tp + fn > 0 then tp / cast(tp + fn as double) else 0e0 end, 6) as recall,
    round(case when tn + fp > 0 then tn / cast(tn + fp as double) else 0e0 end, 6) as specificity,
    round(case when 2 * tp + fp + fn > 0 then 2 * tp / cast(2 * tp + fp + fn as double) else 0e0 end, 6) as f1_score"""


@query("confusion", over("v_fused", _CONFUSION.format(t="0.85e0")))
def confusion(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.confusion(fused(spark, folder))


@query("binary_metrics", over("v_fused", f"select tp, fp, fn, tn, {_RATES} from c", c=_CONFUSION.format(t="0.5e0")))
def binary_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded_all(evaluation.binary_metrics(fused(spark, folder), 0.5))


@query("binary_metrics_missing", over(
    "v_gappy_fused", f"select tp, fp, fn, tn, {_RATES} from c", c=_CONFUSION.format(t="0.5e0").replace("v_fused", "v_gappy_fused")
))
def binary_metrics_missing(spark: SparkSession, folder: str) -> DataFrame:
    raw = views.gappy_scored(spark, folder).withColumn("score", F.col("s_lstm") * 0.47 + F.col("s_if") * 0.28 + F.col("s_gnn") * 0.25)
    return rounded_all(evaluation.binary_metrics(raw, 0.5))


_CUMULATIVE = """select score as threshold, pos, neg, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over () as p, sum(neg) over () as n
    from (select score, count(*) filter (where y_true = 1) as pos, count(*) filter (where y_true = 0) as neg from v_fused group by score) g
    window w as (order by score desc rows unbounded preceding)"""


@query("roc_curve", over(
    "v_fused",
    """select threshold, round(fp / cast(n as double), 6) as fpr, round(tp / cast(p as double), 6) as tpr from cum
       union all select cast('infinity' as double), 0e0, 0e0""",
    cum=_CUMULATIVE,
))
def roc_curve(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.roc_curve(fused(spark, folder)).select("threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query("pr_curve", over(
    "v_fused",
    """select threshold, round(tp / cast(tp + fp as double), 6) as precision, round(tp / cast(p as double), 6) as recall from cum
       union all select cast(null as double), 1e0, 0e0""",
    cum=_CUMULATIVE,
))
def pr_curve(spark: SparkSession, folder: str) -> DataFrame:
    curve = evaluation.pr_curve(fused(spark, folder))
    return curve.select("threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


_ROC_AUC = "select sum(cast(pos as double) * ((n - fp) + neg / 2e0)) / (cast(max(p) as double) * max(n)) from cum"
_PR_AUC = """select sum((recall - last_recall) * (precision + last_precision) / 2e0) from (
    select tp / cast(p as double) as recall, tp / cast(tp + fp as double) as precision,
        coalesce(lag(tp) over o / cast(p as double), 0e0) as last_recall,
        coalesce(lag(tp) over o / cast(lag(tp + fp) over o as double), 1e0) as last_precision
    from cum window o as (order by threshold desc)) z"""


@query("roc_auc", over("v_fused", f"select round(({_ROC_AUC}), 6) as roc_auc", cum=_CUMULATIVE))
def roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    return rounded_all(evaluation.curve_areas(fused(spark, folder)).select("roc_auc"))


@query("pr_auc", over("v_fused", f"select round(({_PR_AUC}), 6) as pr_auc", cum=_CUMULATIVE))
def pr_auc(spark: SparkSession, folder: str) -> DataFrame:
    return rounded_all(evaluation.curve_areas(fused(spark, folder)).select("pr_auc"))


_SWEEP_COUNTS = """select i * cast(0.01 as double) as threshold, count(*) filter (where score >= i * cast(0.01 as double) and y_true = 1) as tp,
    count(*) filter (where score >= i * cast(0.01 as double) and y_true = 0) as fp, count(*) filter (where score < i * cast(0.01 as double) and y_true = 1) as fn,
    count(*) filter (where score < i * cast(0.01 as double) and y_true = 0) as tn from v_fused, (select unnest(range(0, 101)) as i) steps group by i"""
_SWEEP = f"select round(threshold, 6) as threshold, tp, fp, fn, tn, {_RATES} from sweep"


@query("threshold_sweep", over("v_fused", _SWEEP, sweep=_SWEEP_COUNTS))
def threshold_sweep(spark: SparkSession, folder: str) -> DataFrame:
    return rounded_all(evaluation.threshold_sweep(fused(spark, folder)))


_F1 = "case when 2 * tp + fp + fn > 0 then 2 * tp / cast(2 * tp + fp + fn as double) else 0e0 end"


@query("threshold_opt", over("v_fused", f"select *, f1_score as optimized from ({_SWEEP} order by {_F1} desc, threshold limit 1) b", sweep=_SWEEP_COUNTS))
def threshold_opt(spark: SparkSession, folder: str) -> DataFrame:
    return rounded_all(evaluation.best_threshold(fused(spark, folder)))


def _best_query(metric: str, oracle: str) -> None:
    @query(f"threshold_opt_{metric}", over("v_fused", oracle, sweep=_SWEEP_COUNTS, cum=_CUMULATIVE))
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return rounded_all(evaluation.best_threshold(fused(spark, folder), metric))


_PRECISION, _RECALL = ("case when tp + {0} > 0 then tp / cast(tp + {0} as double) else 0e0 end".format(x) for x in ("fp", "fn"))
_best_query("precision", f"select *, precision as optimized from ({_SWEEP} order by {_PRECISION} desc, threshold limit 1) b")
_best_query("recall", f"select *, recall as optimized from ({_SWEEP} order by {_RECALL} desc, threshold limit 1) b")
_best_query("roc_auc", f"select *, (select round(({_ROC_AUC}), 6)) as optimized from ({_SWEEP} order by threshold limit 1) b")


_CLASSES = """select 'Normal' as class, tn as hit, fn as wrong, fp as missed from c union all select 'Anomaly', tp, fp, fn from c"""
_PER_CLASS = """select class, case when hit + wrong > 0 then hit / cast(hit + wrong as double) else 0e0 end as precision,
    case when hit + missed > 0 then hit / cast(hit + missed as double) else 0e0 end as recall,
    case when 2 * hit + wrong + missed > 0 then 2 * hit / cast(2 * hit + wrong + missed as double) else 0e0 end as f1_score, hit + missed as support from classes"""


@query("class_report", over(
    "v_fused",
    """select class, round(precision, 6) as precision, round(recall, 6) as recall, round(f1_score, 6) as f1_score, support from per_class
       union all select 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1_score), 6), cast(sum(support) as bigint) from per_class
       union all select 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
       round(sum(f1_score * support) / sum(support), 6), cast(sum(support) as bigint) from per_class""",
    c=_CONFUSION.format(t="0.5e0"), classes=_CLASSES, per_class=_PER_CLASS,
))
def class_report(spark: SparkSession, folder: str) -> DataFrame:
    return rounded_all(evaluation.class_report(fused(spark, folder), 0.5))


@query("dataset_stats", over(
    "v_scored",
    """select count(*) as total_samples, count(*) filter (where y_true = 0) as normal_samples, count(*) filter (where y_true = 1) as anomaly_samples,
       round(avg(y_true), 6) as anomaly_ratio from v_scored""",
))
def dataset_stats(spark: SparkSession, folder: str) -> DataFrame:
    return rounded_all(evaluation.dataset_stats(views.scored(spark, folder)))


_REPORT = over(
    "v_fused",
    f"""select (select count(*) from v_fused) as total_samples, c.tp, c.fp, round((c.tp + c.tn) / cast(c.tp + c.fp + c.fn + c.tn as double), 6) as accuracy,
        round(({_ROC_AUC}), 6) as roc_auc, round(({_PR_AUC}), 6) as pr_auc, round(best.threshold, 6) as best_threshold, best.f1_score as best_f1,
        (select round(avg(score), 6) from v_fused) as mean_score, 0.5e0 as threshold, 4 as report_rows from c, best""",
    c=_CONFUSION.format(t="0.5e0"), cum=_CUMULATIVE, sweep=_SWEEP_COUNTS, best=f"{_SWEEP} order by {_F1} desc, threshold limit 1",
)


@query("eval_report", _REPORT)
def eval_report(spark: SparkSession, folder: str) -> DataFrame:
    return _report_row(evaluation.evaluation_report(fused(spark, folder), 0.5))


@query("eval_report_file", _REPORT)
def eval_report_file(spark: SparkSession, folder: str) -> DataFrame:
    """The report written as JSON and read back."""
    report = evaluation.evaluation_report(fused(spark, folder), 0.5)
    location = writers.write_report(report, scratch_path(spark, "report"))
    return _report_row(spark.read.schema(report.schema).json(location))


def _report_row(report: DataFrame) -> DataFrame:
    c = F.col
    return rounded_all(
        report.select(
            c("dataset_statistics.total_samples").alias("total_samples"),
            c("metrics_at_threshold.tp").alias("tp"),
            c("metrics_at_threshold.fp").alias("fp"),
            c("metrics_at_threshold.accuracy").alias("accuracy"),
            c("areas.roc_auc").alias("roc_auc"),
            c("areas.pr_auc").alias("pr_auc"),
            c("optimal_metrics.threshold").alias("best_threshold"),
            c("optimal_metrics.f1_score").alias("best_f1"),
            c("score_statistics.mean").alias("mean_score"),
            c("threshold"),
            F.size("classification_report").alias("report_rows"),
        )
    )
