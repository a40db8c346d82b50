"""Running totals over a whole table in value order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_RANGE = 500_000
MAX_RANGES = 4_096


def value_ranges(df: DataFrame, col: str, rows_per_range: int = ROWS_PER_RANGE) -> list[float]:
    """Cut points that split ``col`` into ranges of similar row counts; empty for small tables."""
    n = df.agg(F.count(col)).first()[0]
    wanted = min(MAX_RANGES, n // rows_per_range)
    if wanted < 2:
        return []
    shares = F.array(*[F.lit(i / wanted) for i in range(1, wanted)])
    return sorted(set(df.agg(F.percentile_approx(F.col(col).cast("double"), shares, 10 * wanted)).first()[0]))


def running_totals(df: DataFrame, value: str, sums: Sequence[str], cuts: Sequence[float], *, descending: bool = True) -> DataFrame:
    """Add ``cum_<s>``, the inclusive running sum of each ``s`` ordered by the unique ``value``.

    Totals per range (at most ``MAX_RANGES`` rows) are summed first and broadcast;
    the window then runs inside each range.
    """
    df = df.withColumn(value, F.col(value).cast("double"))
    if cuts:
        edges = [-float("inf"), *cuts, float("inf")]
        df = Bucketizer(splits=edges, inputCol=value, outputCol="_range", handleInvalid="keep").transform(df)
    else:
        df = df.withColumn("_range", F.lit(0.0))
    way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    before = Window.orderBy(way("_range")).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_range").orderBy(way(value)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if not cuts:
        return df.withColumns({f"cum_{s}": F.sum(s).over(inside) for s in sums}).drop("_range")
    totals = df.groupBy("_range").agg(*[F.sum(s).alias(s) for s in sums])
    offsets = totals.select("_range", *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_off_{s}") for s in sums])
    return (
        df.join(F.broadcast(offsets), "_range")
        .withColumns({f"cum_{s}": F.col(f"_off_{s}") + F.sum(s).over(inside) for s in sums})
        .drop("_range", *[f"_off_{s}" for s in sums])
    )
