"""Missing values and outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telewarden.functions.ordered import last_known
from telewarden.functions.quantiles import IN_MEMORY, quantile_table
from telewarden.functions.vectors import known


def nan_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NaN cells become nulls, as missing cells are below; every function that counts, fills or fits does it first."""
    return df.withColumns({c: known(F.col(c)) for c in cols})


def missing_count(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    df = nan_to_null(df, cols)
    per_column = [F.count_if(F.col(c).isNull()) for c in cols]
    total = per_column[0]
    for n in per_column[1:]:
        total = total + n
    return df.agg(total.alias("missing"), *[n.alias(f"missing_{c}") for n, c in zip(per_column, cols)])


def one_row(stats: DataFrame) -> Column:
    """A one-row table as a struct value usable in any expression; Spark runs it once."""
    return stats.select(F.struct("*")).scalar()


def settled(stats: DataFrame) -> DataFrame:
    """A fitted one-row table as values: computed once, however often later steps refer to it."""
    return stats.sparkSession.createDataFrame([stats.first()], stats.schema)


def fit_means(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return nan_to_null(df, cols).agg(*[F.avg(c).alias(c) for c in cols])


def fill_mean(df: DataFrame, cols: Sequence[str], means: DataFrame | None = None) -> DataFrame:
    """Fill with the means of ``df``, or fitted ones."""
    means = one_row(means if means is not None else fit_means(df, cols))
    df = nan_to_null(df, cols)
    return df.withColumns({c: F.coalesce(F.col(c), means[c]) for c in cols})


def fill_median(df: DataFrame, cols: Sequence[str], *, in_memory: int = IN_MEMORY) -> DataFrame:
    df = nan_to_null(df, cols)
    medians = one_row(quantile_table(df, cols, [0.5], in_memory))
    return df.withColumns({c: F.coalesce(F.col(c), medians[c][0]) for c in cols})


def fill_forward(df: DataFrame, cols: Sequence[str], *, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last earlier known value of the entity; leading nulls stay. ``order`` starts with the time."""
    return last_known(nan_to_null(df, cols), cols, keys, order, order[0])


def fill_drop(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return nan_to_null(df, cols).na.drop("any", subset=list(cols))


FILL = {"mean": fill_mean, "median": fill_median, "drop": fill_drop}


def handle_missing(df: DataFrame, cols: Sequence[str], strategy: str = "mean", **order) -> DataFrame:
    if strategy == "forward_fill":
        return fill_forward(df, cols, **order)
    return FILL[strategy](df, cols)


def iqr_bounds(df: DataFrame, cols: Sequence[str], *, in_memory: int = IN_MEMORY) -> DataFrame:
    """One row with a ``(lower, upper)`` struct per column."""
    quartiles = quantile_table(nan_to_null(df, cols), cols, [0.25, 0.75], in_memory)

    def bounds(c: str) -> Column:
        q1, q3 = F.col(c)[0], F.col(c)[1]
        reach = (q3 - q1) * F.lit(1.5)
        return F.struct((q1 - reach).alias("lower"), (q3 + reach).alias("upper")).alias(c)

    return quartiles.select(*[bounds(c) for c in cols])


def flag_iqr(df: DataFrame, cols: Sequence[str], bounds: DataFrame | None = None, *, flag: str = "is_outlier", in_memory: int = IN_MEMORY) -> DataFrame:
    """Flag rows with any column strictly outside the interquartile fences."""
    limits = one_row(bounds if bounds is not None else iqr_bounds(df, cols, in_memory=in_memory))
    outside = F.lit(False)
    for c in cols:
        known = ~F.isnan(F.col(c).cast("double"))
        outside = outside | F.coalesce(known & ((F.col(c) < limits[c]["lower"]) | (F.col(c) > limits[c]["upper"])), F.lit(False))
    return df.withColumn(flag, outside)


def flag_zscore(df: DataFrame, cols: Sequence[str], threshold: float = 3.0, *, scope: str = "global", flag: str = "is_outlier") -> DataFrame:
    """Flag rows with any ``|x - mean| / std > threshold`` (population std).

    ``scope='global'`` uses one mean and std over all cells, ``'column'`` one pair
    per column. A zero std flags nothing.
    """
    per_column = nan_to_null(df, cols).agg(
        *[F.count(c).alias(f"n_{c}") for c in cols],
        *[F.avg(c).alias(f"mu_{c}") for c in cols],
        *[F.var_pop(c).alias(f"var_{c}") for c in cols],
    )
    if scope == "global":
        n = sum((F.col(f"n_{c}") for c in cols[1:]), F.col(f"n_{cols[0]}"))
        mean = sum((F.coalesce(F.col(f"n_{c}") * F.col(f"mu_{c}"), F.lit(0.0)) for c in cols), F.lit(0.0)) / n
        pooled = per_column.withColumn("mu", mean).withColumn("n", n)
        spread = [F.coalesce(F.col(f"n_{c}") * (F.col(f"var_{c}") + F.pow(F.col(f"mu_{c}") - F.col("mu"), F.lit(2.0))), F.lit(0.0)) for c in cols]
        stats = one_row(pooled.select("mu", F.sqrt(sum(spread, F.lit(0.0)) / F.col("n")).alias("sd")))
        centre, scale = {c: stats["mu"] for c in cols}, {c: stats["sd"] for c in cols}
    else:
        stats = one_row(per_column.select("*", *[F.sqrt(f"var_{c}").alias(f"sd_{c}") for c in cols]))
        centre, scale = {c: stats[f"mu_{c}"] for c in cols}, {c: stats[f"sd_{c}"] for c in cols}
    outside = F.lit(False)
    for c in cols:
        z = F.abs(F.try_divide(F.col(c) - centre[c], scale[c]))
        outside = outside | F.coalesce(~F.isnan(z) & (z > threshold), F.lit(False))
    return df.withColumn(flag, outside)


def remove_outliers(flagged: DataFrame, *, flag: str = "is_outlier") -> DataFrame:
    return flagged.where(~F.col(flag)).drop(flag)


def outlier_summary(flagged: DataFrame, *, flag: str = "is_outlier") -> DataFrame:
    hit = F.col(flag).cast("int")
    return flagged.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(hit).cast("long").alias("outliers"),
        (F.avg(hit) * F.lit(100.0)).alias("percent"),
    )
