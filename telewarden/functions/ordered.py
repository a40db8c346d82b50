"""Row order within an entity, computed in bounded pieces.

A plain ``Window.partitionBy(entity)`` puts every row of an entity into one
task, which fails once one entity holds a large share of the data. The
functions here cut each entity into time buckets, compute what crosses a bucket
border from a small per-bucket summary, and only window inside a bucket.
Results equal those of the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telewarden.session import cut_lineage

BUCKET_ROWS = 1_000_000
CHUNK_ROWS = 100_000
_DAY = 86_400e6
BURST_FACTOR = 10
MAX_RANGES = 20_000
_KEY, _RANGE = "_tw_key", "_tw_range"


def epoch_micros(time_col: str) -> Column:
    return F.unix_micros(F.col(time_col).cast("timestamp"))


def time_bucket(df: DataFrame, time_col: str, rows: int = BUCKET_ROWS) -> Column:
    """Number of the time bucket a row falls in, sized for about ``rows`` rows of all entities.

    The width follows from the table's own span and count, in one pass over the
    time column, and is a microsecond to a day.
    """
    stats = df.select(epoch_micros(time_col).alias("t")).agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("t").alias("n"))
    even = (F.col("hi") - F.col("lo")) * F.lit(float(rows)) / F.greatest(F.col("n"), F.lit(1))
    width = stats.select(F.greatest(F.lit(1.0), F.least(F.lit(_DAY), even))).scalar()
    return F.floor(epoch_micros(time_col) / width).cast("long")


def _with_key(df: DataFrame, keys: Sequence[str], bucket: Column) -> DataFrame:
    # A struct key compares nulls as equal, as window partitions do.
    return df.withColumn(_KEY, F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], bucket.alias("b")))


def _bucketed(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], time_col: str, rows: int, aggregates: Sequence[Column]
) -> tuple[DataFrame, DataFrame]:
    """Rows with their (entity, bucket) key, and the stored summary per key.

    Time buckets do unless a burst puts many times ``rows`` rows of an entity into one, even at
    a single instant. Then the table is cut into ranges of the whole sort key, which Spark balances
    by sampling, and stored so that the cuts stay as they are.
    """
    def summarise(keyed: DataFrame) -> DataFrame:
        return cut_lineage(keyed.groupBy(_KEY).agg(F.count(F.lit(1)).alias("_n"), *aggregates), "buckets")

    keyed = _with_key(df, keys, time_bucket(df, time_col, rows))
    summary = summarise(keyed)
    size = summary.agg(F.max("_n").alias("worst"), F.sum("_n").alias("all")).first()
    if (size["worst"] or 0) <= rows * BURST_FACTOR:
        return keyed, summary
    ranges = min(MAX_RANGES, -(-size["all"] // rows))
    cut = df.repartitionByRange(ranges, *keys, *order).withColumn(_RANGE, F.spark_partition_id())
    keyed = _with_key(cut_lineage(cut, "ranges"), keys, F.col(_RANGE).cast("long")).drop(_RANGE)
    return keyed, summarise(keyed)


def _entity_columns(n: int) -> list[Column]:
    return [F.col(f"{_KEY}.k{i}") for i in range(n)]


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    time_col: str,
    *,
    name: str = "pos",
    running: Mapping[str, Column] | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Add the 0-based position of each row within its entity.

    ``order`` must start with ``time_col`` and identify rows. ``running`` adds,
    per name, the inclusive running count of rows where the condition holds.
    """
    running = dict(running or {})
    counts = [F.count_if(c).alias(f"_n_{r}") for r, c in running.items()]
    keyed, per_bucket = _bucketed(df, keys, order, time_col, bucket_rows, counts)
    earlier = (
        Window.partitionBy(*(_entity_columns(len(keys)) or [F.lit(0)]))
        .orderBy(F.col(f"{_KEY}.b"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = per_bucket.select(
        _KEY,
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"),
        *[F.coalesce(F.sum(f"_n_{r}").over(earlier), F.lit(0)).alias(f"_off_{r}") for r in running],
    )
    inside = Window.partitionBy(_KEY).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        keyed.join(offsets, _KEY)
        .withColumn(name, F.col("_off") + F.row_number().over(inside) - 1)
        .withColumns({r: F.col(f"_off_{r}") + F.count_if(c).over(upto) for r, c in running.items()})
        .drop(_KEY, "_off", *[f"_off_{r}" for r in running])
    )


def frame_chunks(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    time_col: str,
    frame: int,
    *,
    chunk_rows: int = CHUNK_ROWS,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Cut entities into chunks that can evaluate a frame of ``frame`` trailing rows alone.

    Adds ``pos`` and ``_chunk``; the last ``frame - 1`` rows of a chunk are also
    copied to the next one. Window by ``chunk_window`` and keep ``own_rows``.
    """
    halo = frame - 1
    rows = max(chunk_rows, halo, 1)
    home = F.floor(F.col("pos") / F.lit(rows)).cast("long")
    positioned = with_position(df, keys, order, time_col, bucket_rows=bucket_rows)
    copies = F.when(F.col("pos") % rows >= rows - halo, F.array(home, home + 1)).otherwise(F.array(home))
    return positioned.withColumn("_chunk", F.explode(copies)).withColumn("_own", F.col("_chunk") == home)


def chunk_window(keys: Sequence[str]):
    return Window.partitionBy(*keys, "_chunk").orderBy("pos")


def own_rows(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_chunk", "_own")


def last_known(
    df: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str],
    order: Sequence[str],
    time_col: str,
    *,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Replace nulls in ``cols`` by the entity's last earlier non-null value."""
    rank = F.struct(*order)
    latest = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(f"_last_{c}") for c in cols]
    keyed, summary = _bucketed(df, keys, order, time_col, bucket_rows, latest)
    earlier = (
        Window.partitionBy(*(_entity_columns(len(keys)) or [F.lit(0)]))
        .orderBy(F.col(f"{_KEY}.b"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = summary.select(_KEY, *[F.last(f"_last_{c}", ignorenulls=True).over(earlier).alias(f"_carry_{c}") for c in cols])
    inside = Window.partitionBy(_KEY).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        keyed.join(carried, _KEY)
        .withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_carry_{c}")) for c in cols})
        .select(*df.columns)
    )
