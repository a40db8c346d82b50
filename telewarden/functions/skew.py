"""Joins and samples that keep hot keys from landing in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_KEYS = 256
SALTS = 64
BROADCAST_ROWS = 50_000
#: Rows that samples are drawn from, in expectation.
POOL_ROWS = 1_000_000
_HOT, _SALT = "_tw_hot", "_tw_salt"


def hot_keys(df: DataFrame, on: Sequence[str], limit: int = HOT_KEYS) -> DataFrame:
    """Keys holding more than 1/``limit`` of all rows; there can be fewer than ``limit`` of them."""
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total = df.count()  # a count of rows, where a sum over the groups would group twice
    return counts.where(F.col("_n") * F.lit(limit) > total).select(*on)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table has at most ``rows`` rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def lookup_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", *, limit: int = HOT_KEYS, salts: int = SALTS, small_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Join ``left`` to ``right``, which has at most one row per key. Pass stored tables, as both are counted first.

    A right side of at most ``small_rows`` rows is broadcast. Beyond that, left rows of
    hot keys are spread over ``salts`` tasks and the few right rows they need are
    repeated that often; without hot keys it is a plain shuffle join.
    """
    on = list(on)
    if is_small(right, small_rows):
        return left.join(F.broadcast(right), on, how)
    hot = find_hot_keys(left, on, limit)
    if hot is None:
        return left.join(right, on, how)
    return spread(left, on, hot, salts).join(repeat(right, on, hot, salts), [*on, _SALT], how).drop(_SALT)


def find_hot_keys(df: DataFrame, on: Sequence[str], limit: int = HOT_KEYS) -> DataFrame | None:
    """``hot_keys`` as a local table of fewer than ``limit`` rows, or None."""
    keys = hot_keys(df, on, limit)
    found = keys.collect()
    return df.sparkSession.createDataFrame(found, keys.schema) if found else None


def _is_hot(df: DataFrame, on: Sequence[str], hot: DataFrame) -> DataFrame:
    marked = hot.withColumn(_HOT, F.lit(True))
    return df.join(F.broadcast(marked), list(on), "left")


def spread(df: DataFrame, on: Sequence[str], hot: DataFrame, salts: int = SALTS) -> DataFrame:
    """Add a salt: by row content for hot keys, else 0."""
    row = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts)).cast("int")
    return _is_hot(df, on, hot).withColumn(_SALT, F.when(F.col(_HOT), row).otherwise(0)).drop(_HOT)


def repeat(df: DataFrame, on: Sequence[str], hot: DataFrame, salts: int = SALTS) -> DataFrame:
    """Repeat the rows of hot keys once per salt."""
    every = F.when(F.col(_HOT), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return _is_hot(df, on, hot).withColumn(_SALT, F.explode(every)).drop(_HOT)


def unit_hash(*cols: Column) -> Column:
    """A uniform number in [0, 1) fixed by the given columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


_LEHMER = 2_147_483_647


def lehmer_unit(number: Column, group: Column, tag: int) -> Column:
    """Like ``unit_hash`` for whole numbers, by arithmetic that any SQL engine can repeat: two Lehmer steps around a square."""
    base = F.pmod(number.cast("long"), F.lit(_LEHMER)) * 48_271 % _LEHMER
    moved = (base + group.cast("long") * 7_919 + tag * 104_729) % _LEHMER
    return (moved * moved % _LEHMER * 48_271 % _LEHMER).cast("double") / F.lit(float(_LEHMER))


def lehmer_unit_sql(number: str, group: str, tag: int) -> str:
    """SQL for ``lehmer_unit``."""
    moved = f"((({number}) % {_LEHMER} * 48271 % {_LEHMER} + ({group}) * 7919 + {tag * 104_729}) % {_LEHMER})"
    return f"(cast({moved} * {moved} % {_LEHMER} * 48271 % {_LEHMER} as double) / {_LEHMER}e0)"


def hash_subsamples(df: DataFrame, id_col: str, groups: int, size: int, seed: int, *, group_col: str, surplus: int = 4, n: int | None = None) -> DataFrame:
    """``groups`` seeded samples of up to ``size`` rows without replacement.

    A row's membership depends on its id only, never on partitioning. One rule holds at every size: a pool of about
    ``POOL_ROWS`` rows is drawn by a hash of the id, and each group draws about ``surplus * size`` of the pool by a hash of id and
    group, independently of other groups. Only those reach the ranking shuffle.
    """
    n = max(1, df.count() if n is None else n)
    pool = min(n, POOL_ROWS)
    pooled = df.where(unit_hash(F.col(id_col), F.lit(seed), F.lit("pool")) < pool / n)
    chosen = F.filter(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: unit_hash(F.col(id_col), g, F.lit(seed)) < min(1.0, size * surplus / pool))
    offered = pooled.withColumn(group_col, F.explode(chosen))
    # An explicit partition count keeps adaptive execution from packing all small groups into one task.
    offered = offered.repartition(min(groups, df.sparkSession.sparkContext.defaultParallelism), group_col)
    rank = F.row_number().over(
        Window.partitionBy(group_col).orderBy(F.xxhash64(F.col(id_col), F.col(group_col), F.lit(seed), F.lit("rank")), F.col(id_col))
    )
    return offered.withColumn("_rank", rank).where(F.col("_rank") <= size)
