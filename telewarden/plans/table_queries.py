"""Windows, cleaning, scaling, sequences and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telewarden.operators import autoencoder, cleaning, pca, scaling, sequences, windows
from telewarden.operators.features import with_features
from telewarden.plans import views
from telewarden.plans.flagship import FEATURE_COLUMNS
from telewarden.plans.ingest_queries import finish
from telewarden.plans.registry import grid, grid_sql, over, query
from telewarden.functions.skew import lookup_join
from telewarden.schemas import FEATURE_WINDOW
from telewarden.session import cut_lineage, scratch_path
from telewarden.sources import readers

COLS = views.DIRTY_COLUMNS


def rounded(df: DataFrame, ids: list[str], cols: list[str], digits: int = 6) -> DataFrame:
    return df.select(*ids, *[F.round(c, digits).alias(c) for c in cols])


# ---- window statistics

_MEANS = ", ".join(f"{grid_sql(f'avg(f{i})', 4)} as m{i}" for i in range(8))
_VARS = ", ".join(f"{grid_sql(f'var_pop(f{i})', 3)} as v{i}" for i in range(8))
WINDOW_NAMES = [f"m{i}" for i in range(8)] + [f"v{i}" for i in range(8)]


def window_sql(interval: str, seconds: int) -> str:
    end = f"epoch_ms(time_bucket(interval '{interval}', ts)) + {seconds * 1000}"
    return f"select {end} as timestamp, node_name, count(*) as window_size, {_MEANS}, {_VARS} from v_features group by 1, 2"


def split_statistics(stats: DataFrame) -> DataFrame:
    slots = [grid(F.col("features")[i], 4 if i < 8 else 3).alias(n) for i, n in enumerate(WINDOW_NAMES)]
    return stats.select("timestamp", "node_name", "window_size", *slots)


def statistics(spark: SparkSession, folder: str, length: str) -> DataFrame:
    return windows.window_statistics(with_features(views.telemetry(spark, folder)), FEATURE_COLUMNS, length=length)


@query("window_feature_stats", over("v_features", window_sql("60 seconds", 60)))
def window_feature_stats(spark: SparkSession, folder: str) -> DataFrame:
    return split_statistics(statistics(spark, folder, "60 seconds"))


@query("window_stats_missing", over("v_features", window_sql("6 hours", 21600)).replace(
    "value as cpu_usage", "case when event_id % 9 <> 4 then value end as cpu_usage"
).replace(
    "cast(regexp_extract(props, '([0-9]+)', 1) as double) as memory_usage", "case when event_id % 7 <> 3 then cast(regexp_extract(props, '([0-9]+)', 1) as double) end as memory_usage"
))
def window_stats_missing(spark: SparkSession, folder: str) -> DataFrame:
    """Window statistics of telemetry with NaN and null cells, which count in none of their columns."""
    gappy = with_features(views.gappy_telemetry(spark, folder))
    return split_statistics(windows.window_statistics(gappy, FEATURE_COLUMNS, length="6 hours"))


@query("window_feature_stats_6h", over("v_features", window_sql("6 hours", 21600)))
def window_feature_stats_6h(spark: SparkSession, folder: str) -> DataFrame:
    return split_statistics(statistics(spark, folder, "6 hours"))


@query("scan_features", over("v_features", window_sql("6 hours", 21600)))
def scan_features(spark: SparkSession, folder: str) -> DataFrame:
    """Feature records as JSON files, read back as a stream."""
    location = scratch_path(spark, "features")
    statistics(spark, folder, "6 hours").write.json(location)
    stream = readers.open_records(spark, location, FEATURE_WINDOW, fmt="json", streaming=True)
    return split_statistics(finish(stream, spark, "scan-features"))


@query("window_sliding", over(
    "v_telemetry",
    """select epoch_ms(time_bucket(interval '10 seconds', ts)) + 10000 * (k + 1) as timestamp, node_name, count(*) as window_size,
       {m0} as m0, {v0} as v0
       from v_telemetry, (select unnest(range(0, 6)) as k) s group by 1, 2""".format(m0=grid_sql("avg(cpu_usage)", 4), v0=grid_sql("var_pop(cpu_usage)", 3)),
))
def window_sliding(spark: SparkSession, folder: str) -> DataFrame:
    stats = windows.window_statistics(views.telemetry(spark, folder), ["cpu_usage"], slide="10 seconds")
    m0, v0 = F.col("features")[0], F.col("features")[1]
    return stats.select("timestamp", "node_name", "window_size", grid(m0, 4).alias("m0"), grid(v0, 3).alias("v0"))


@query("window_gap_fill", over(
    "v_features",
    """select c.timestamp, c.node_name, coalesce(window_size, 0) as window_size, {cells}
       from (select node_name, unnest(generate_series(min(timestamp), max(timestamp), 3600000)) as timestamp from stats group by node_name) c
       left join stats using (node_name, timestamp)""".format(cells=", ".join(f"coalesce({n}, 0) as {n}" for n in WINDOW_NAMES)),
    stats=window_sql("1 hour", 3600),
))
def window_gap_fill(spark: SparkSession, folder: str) -> DataFrame:
    filled = windows.fill_gaps(statistics(spark, folder, "1 hour"), length_ms=3_600_000, width=len(WINDOW_NAMES))
    return split_statistics(filled)


# ---- missing values

@query("missing_count", over(
    "v_dirty",
    """select count(*) filter (where x1 is null) + count(*) filter (where x2 is null) + count(*) filter (where x3 is null) + count(*) filter (where x4 is null) as missing, count(*) filter (where x1 is null) as missing_x1,
       count(*) filter (where x2 is null) as missing_x2, count(*) filter (where x3 is null) as missing_x3, count(*) filter (where x4 is null) as missing_x4 from v_dirty""",
))
def missing_count(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.missing_count(views.dirty(spark, folder), COLS)


def _fill_sql(value: str) -> str:
    return "select event_id, " + ", ".join(f"round(coalesce({c}, (select {value.format(c)} from v_dirty)), 6) as {c}" for c in COLS) + " from v_dirty"


@query("fill_mean", over("v_dirty", _fill_sql("avg({})")))
def fill_mean(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(cleaning.handle_missing(views.dirty(spark, folder), COLS, "mean"), ["event_id"], COLS)


@query("fill_median", over("v_dirty", _fill_sql("median({})")))
def fill_median(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(cleaning.handle_missing(views.dirty(spark, folder), COLS, "median"), ["event_id"], COLS)


@query("fill_forward", over(
    "v_dirty",
    "select event_id, node_name, "
    + ", ".join(
        f"last_value({c} ignore nulls) over (partition by node_name order by ts, event_id rows between unbounded preceding and current row) as {c}"
        for c in COLS
    )
    + " from v_dirty",
))
def fill_forward(spark: SparkSession, folder: str) -> DataFrame:
    filled = cleaning.handle_missing(views.dirty(spark, folder), COLS, "forward_fill", keys=["node_name"], order=["ts", "event_id"])
    return filled.select("event_id", "node_name", *COLS)


@query("fill_drop", over("v_dirty", "select event_id, x1, x2, x3, x4 from v_dirty where x1 is not null and x2 is not null and x3 is not null and x4 is not null"))
def fill_drop(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.handle_missing(views.dirty(spark, folder), COLS, "drop").select("event_id", *COLS)


# ---- outliers

_FENCES = "select " + ", ".join(
    f"quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) as {c}_lo, "
    f"quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) as {c}_hi"
    for c in COLS
)
_OUTSIDE = " or ".join(f"coalesce({c} < {c}_lo or {c} > {c}_hi, false)" for c in COLS)


@query("outliers_iqr", over(
    "v_dirty", f"select event_id, x1, x2, x3, x4, {_OUTSIDE} as is_outlier from v_dirty, fences", fences=_FENCES + " from v_dirty"
))
def outliers_iqr(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.flag_iqr(views.dirty(spark, folder), COLS).select("event_id", *COLS, "is_outlier")


@query("outlier_summary", over(
    "v_dirty",
    f"""select count(*) as n, cast(sum(cast({_OUTSIDE} as int)) as bigint) as outliers,
        round(100e0 * avg(cast({_OUTSIDE} as int)), 6) as percent from v_dirty, fences""",
    fences=_FENCES + " from v_dirty",
))
def outlier_summary(spark: SparkSession, folder: str) -> DataFrame:
    flagged = cleaning.flag_iqr(views.dirty(spark, folder), COLS)
    return cleaning.outlier_summary(flagged).withColumn("percent", F.round("percent", 6))


@query("outliers_zscore", over(
    "v_dirty",
    "select event_id, " + " or ".join(f"coalesce(abs({c} - mu) / sd > 3, false)" for c in COLS) + " as is_outlier from v_dirty, stats",
    stats="select avg(x) as mu, stddev_pop(x) as sd from (" + " union all ".join(f"select {c} as x from v_dirty" for c in COLS) + ") cells",
))
def outliers_zscore(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.flag_zscore(views.dirty(spark, folder), COLS).select("event_id", "is_outlier")


# ---- scaling

_SCALES = {
    "standard": ("avg({0})", "stddev_pop({0})"),
    "minmax": ("min({0})", "max({0}) - min({0})"),
    "robust": ("median({0})", "quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)"),
}


def _params_sql(kind: str, source: str) -> str:
    centre, spread = _SCALES[kind]
    return "select " + ", ".join(
        f"{centre.format(c)} as {c}_c, case when {spread.format(c)} = 0 then 1e0 else {spread.format(c)} end as {c}_s" for c in COLS
    ) + f" from {source}"


def _scaled_sql(source: str) -> str:
    return "select event_id, " + ", ".join(f"round(({c} - {c}_c) / {c}_s, 6) as {c}" for c in COLS) + f" from {source}, params"


def _scale(kind: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return rounded(scaling.fit_scale(views.dirty(spark, folder), COLS, kind), ["event_id"], COLS)

    return run


for _kind in _SCALES:
    query(f"scale_{_kind}", over("v_dirty", _scaled_sql("v_dirty"), params=_params_sql(_kind, "v_dirty")))(_scale(_kind))


_SPLIT = """select event_id, case when row_number() over (order by ts, event_id) <= floor((select count(*) from events) * 0.8e0)
    then 'train' else 'val' end as split from events"""


@query("train_val_split", _SPLIT)
def train_val_split(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.split_by_time(views.events(spark, folder), time_col="ts", id_col="event_id").select("event_id", "split")


@query("scale_holdout", over(
    "v_dirty",
    _scaled_sql("(select d.*, split from v_dirty d join marks using (event_id)) a").replace("select event_id,", "select event_id, split,"),
    marks=_SPLIT,
    params=_params_sql("standard", "v_dirty join marks using (event_id) where split = 'train'"),
))
def scale_holdout(spark: SparkSession, folder: str) -> DataFrame:
    """Fitted on the earliest 80 %, applied to all rows."""
    marked = sequences.split_by_time(views.dirty(spark, folder), time_col="ts", id_col="event_id")
    params = scaling.fit_scaler(marked.where("split = 'train'"), COLS)
    return rounded(scaling.scale(marked, COLS, params), ["event_id", "split"], COLS)


@query("preprocess_all_steps", over(
    "v_dirty",
    _scaled_sql("kept"),
    filled="select event_id, " + ", ".join(f"coalesce({c}, (select avg({c}) from v_dirty)) as {c}" for c in COLS) + " from v_dirty",
    fences=_FENCES + " from filled",
    kept=f"select event_id, x1, x2, x3, x4 from filled, fences where not ({_OUTSIDE})",
    params=_params_sql("standard", "kept"),
))
def preprocess_all_steps(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(scaling.preprocess(views.dirty(spark, folder), COLS), ["event_id"], COLS)


_KEPT = dict(
    filled="select event_id, " + ", ".join(f"coalesce({c}, (select avg({c}) from v_dirty)) as {c}" for c in COLS) + " from v_dirty",
    fences=_FENCES + " from filled",
    kept=f"select event_id, x1, x2, x3, x4 from filled, fences where not ({_OUTSIDE})",
    params=_params_sql("standard", "kept"),
)


@query("preprocess_pca", over(
    "v_dirty",
    f"select event_id, 4 as components, {grid_sql(' + '.join(f'{c} * {c}' for c in COLS), 5)} as square from scaled",
    **_KEPT, scaled=_scaled_sql("kept").replace("round(", "(").replace(", 6)", ")"),
))
def preprocess_pca(spark: SparkSession, folder: str) -> DataFrame:
    """Filled, cleaned, scaled and turned to all principal axes, which keeps every row's distance from the mean."""
    turned = scaling.preprocess(views.dirty(spark, folder), COLS, components=len(COLS))
    square = F.aggregate("features", F.lit(0.0), lambda s, x: s + x * x)
    return turned.select("event_id", F.size("features").alias("components"), grid(square, 5).alias("square"))


@query("pca")
def principal_components(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector's coordinates on all components that make up 95 % of the variance."""
    vectors = readers.read_table(spark, folder, "embeddings")
    projected = pca.fit_pca(vectors, "embedding", 0.95).project(vectors, "embedding", "z")
    cells = projected.select("vec_id", F.posexplode("z").alias("component", "value"))
    return cells.withColumn("value", F.round("value", 6))


@query("pca_variance", """with cells as (select vec_id, unnest(range(1, 65)) as i, unnest(embedding)::double as x from embeddings),
    means as (select i, avg(x) as m from cells group by i)
    select count(distinct vec_id) as vectors, count(distinct i) as components, round(sum((x - m) * (x - m)) / (count(distinct vec_id) - 1), 6) as variance,
    round(sum(m * m) / count(distinct vec_id), 6) as mean_square from cells join means using (i)""")
def pca_variance(spark: SparkSession, folder: str) -> DataFrame:
    """Variance over all components, which only orthonormal axes around the mean keep as it is in the vectors."""
    vectors = readers.read_table(spark, folder, "embeddings")
    model = pca.fit_pca(vectors, "embedding", 64)
    z = model.project(vectors, "embedding", "z").select("vec_id", F.posexplode("z").alias("i", "z"))
    found = z.agg(F.count_distinct("vec_id").alias("vectors"), F.count_distinct("i").alias("components"), F.sum(F.col("z") * F.col("z")).alias("total"))
    return found.select(
        "vectors", "components", F.round(F.col("total") / (F.col("vectors") - 1), 6).alias("variance"), F.round(F.lit(float(model.mean @ model.mean)), 6).alias("mean_square")
    )


# ---- sequences

def _per_node(spark: SparkSession, folder: str, length: int, features: Column) -> DataFrame:
    return sequences.create_sequences(views.telemetry(spark, folder), features, keys=["node_name"], order=["ts", "event_id"], length=length)


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + x)


@query("sequences", over(
    "v_telemetry",
    """select event_id, node_name, len(xs) as length, xs[1] as first_x, xs[-1] as last_x, round(list_sum(xs), 3) as total,
       round(list_sum(list_transform(list_zip(xs, range(0, 60)), lambda z: z[1] * z[2])), 3) as weighted from seqs where len(xs) = 60""",
    seqs="""select event_id, node_name, list(cpu_usage) over (partition by node_name order by ts, event_id rows between 59 preceding and current row) as xs
        from v_telemetry""",
))
def sliding_sequences(spark: SparkSession, folder: str) -> DataFrame:
    built = _per_node(spark, folder, 60, F.col("cpu_usage"))
    xs = F.col("sequence")
    weighted = _sum(F.transform(xs, lambda x, i: x * i))
    return built.select(
        "event_id", "node_name", F.size(xs).cast("long").alias("length"), xs[0].alias("first_x"), F.element_at(xs, -1).alias("last_x"),
        F.round(_sum(xs), 3).alias("total"), F.round(weighted, 3).alias("weighted"),
    )


_SEQ5 = """select event_id, list([cpu_usage, memory_usage]) over (partition by node_name order by ts, event_id
    rows between 4 preceding and current row) as s from v_telemetry"""


@query("flatten_sequence", over(
    "v_telemetry", "select event_id, " + ", ".join(f"flatten(s)[{i + 1}] as x{i}" for i in range(10)) + " from seqs where len(s) = 5", seqs=_SEQ5
))
def flatten_sequence(spark: SparkSession, folder: str) -> DataFrame:
    built = _per_node(spark, folder, 5, F.array("cpu_usage", "memory_usage"))
    flat = built.withColumn("flat", sequences.flatten_sequence(F.col("sequence")))
    return flat.select("event_id", *[F.col("flat")[i].alias(f"x{i}") for i in range(10)])


@query("last_timestep", over("v_telemetry", "select event_id, s[-1][1] as x0, s[-1][2] as x1 from seqs where len(s) = 5", seqs=_SEQ5))
def last_timestep(spark: SparkSession, folder: str) -> DataFrame:
    built = _per_node(spark, folder, 5, F.array("cpu_usage", "memory_usage"))
    last = built.withColumn("last", sequences.last_timestep(F.col("sequence")))
    return last.select("event_id", F.col("last")[0].alias("x0"), F.col("last")[1].alias("x1"))


_SEQ60 = """select timestamp, node_name, list(x) over (partition by node_name order by timestamp rows between 59 preceding and current row) as s
    from (select epoch_ms(time_bucket(interval '6 hours', ts)) + 21600000 as timestamp, node_name,
    [""" + ", ".join([f"avg(f{i})" for i in range(8)] + [f"var_pop(f{i})" for i in range(8)]) + "] as x from v_features group by 1, 2) w"


@query("window_sequences", over(
    "v_features",
    f"""select timestamp, node_name, cast(len(flatten(s)) as int) as width, {grid_sql("list_sum(flatten(s)[1:480])", 1)} as first_half,
        {grid_sql("list_sum(flatten(s)[481:960])", 1)} as second_half, """
    + ", ".join(f"{grid_sql(f's[-1][{i + 1}]', 3)} as last{i}" for i in range(16)) + " from seqs where len(s) = 60",
    seqs=_SEQ60,
))
def window_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """The last 60 windows of each node with their 16 statistics, flattened, and the newest of them."""
    stats = statistics(spark, folder, "6 hours").withColumn("ts", F.timestamp_millis("timestamp"))
    built = sequences.create_sequences(stats, F.col("features"), keys=["node_name"], order=["ts"])
    flat = built.withColumns({"flat": sequences.flatten_sequence(F.col("sequence")), "last": sequences.last_timestep(F.col("sequence"))})
    halves = [grid(_sum(F.slice("flat", a, 480)), 1).alias(n) for a, n in ((1, "first_half"), (481, "second_half"))]
    return flat.select("timestamp", "node_name", F.size("flat").alias("width"), *halves, *[grid(F.col("last")[i], 3).alias(f"last{i}") for i in range(16)])


@query("tile_sequence", over(
    "v_telemetry",
    "select event_id, cast(len(t) as int) as length, t[1][1] as first_x, t[-1][2] as last_x from (select event_id, list_resize(cast([] as double[][]), 60, [cpu_usage, memory_usage]) as t from v_telemetry) q",
))
def tile_sequence(spark: SparkSession, folder: str) -> DataFrame:
    tiled = views.telemetry(spark, folder).withColumn("t", sequences.tile_sequence(F.array("cpu_usage", "memory_usage")))
    return tiled.select("event_id", F.size("t").alias("length"), F.col("t")[0][0].alias("first_x"), F.element_at("t", -1)[1].alias("last_x"))


@query("reconstruction_error", over(
    "v_telemetry",
    """select event_id, round(list_sum(list_transform(list_zip([cpu_usage, memory_usage, cast(process_count as double)], [m0, m1, m2]),
       lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / 3, 3) as error from v_telemetry join means using (node_name)""",
    means="select node_name, avg(cpu_usage) as m0, avg(memory_usage) as m1, avg(process_count) as m2 from v_telemetry group by node_name",
))
def reconstruction_error(spark: SparkSession, folder: str) -> DataFrame:
    """Error against each node's mean vector as the decoded value."""
    t = views.telemetry(spark, folder)
    means = cut_lineage(t.groupBy("node_name").agg(F.array(F.avg("cpu_usage"), F.avg("memory_usage"), F.avg("process_count")).alias("decoded")))
    paired = lookup_join(t, means, ["node_name"]).withColumn("actual", F.array("cpu_usage", "memory_usage", F.col("process_count").cast("double")))
    return autoencoder.reconstruction_error(paired, "actual", "decoded").select("event_id", F.round("error", 3).alias("error"))
