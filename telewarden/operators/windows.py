"""Event-time window statistics per node."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telewarden import schemas
from telewarden.operators.cleaning import nan_to_null

#: Windows of one node that a row of its calendar stands for until it is written out.
CALENDAR_SLOTS = 1_440


def output_slots(cols: Sequence[str], width: int | None = None) -> list[tuple[str, str | None]]:
    """What each output slot holds: ``('mean'|'var', column)``, or no column for padding.

    Without ``width`` every column has its mean, and then every column its population variance. With a ``width`` the
    first half of the slots are means and the rest variances of the leading ones, unused slots being
    padding: for 73 slots, 37 means and 36 variances.
    """
    if width is None:
        return [("mean", c) for c in cols] + [("var", c) for c in cols]
    d = width
    means = (d + 1) // 2
    padded: list[str | None] = [*cols, *[None] * (d - len(cols))]
    return [("mean", padded[i]) for i in range(means)] + [("var", padded[i]) for i in range(d - means)]


def window_statistics(
    df: DataFrame,
    cols: Sequence[str],
    *,
    key: str = "node_name",
    time_col: str = "ts",
    length: str = schemas.WINDOW_LENGTH,
    slide: str | None = None,
    width: int | None = None,
) -> DataFrame:
    """One row per node and window: ``timestamp`` (window end, ms), ``window_size``, ``features``.

    Incremental aggregates only, so map-side partial sums absorb busy nodes and a
    stream keeps sums as state, not rows. A missing value counts in no statistic of its column.
    """
    slots = output_slots(cols, width)
    wanted = {(k, c) for k, c in slots if c is not None}
    df = nan_to_null(df, sorted({c for _, c in wanted}))
    aggregates = [
        (F.avg(c) if kind == "mean" else F.var_pop(c)).alias(f"{kind}_{c}") for kind, c in sorted(wanted)
    ]
    if slide:
        grouped = _from_panes(df, sorted({c for _, c in wanted}), key, time_col, length, slide)
    else:
        frame = F.window(time_col, length, slide) if slide else F.window(time_col, length)
        grouped = df.groupBy(frame.alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("window_size"), *aggregates)
    vector = F.array(*[F.lit(0.0) if c is None else F.col(f"{kind}_{c}") for kind, c in slots])
    return grouped.select(window_end_ms(F.col("w")).alias("timestamp"), key, "window_size", vector.alias("features"))


def _from_panes(df: DataFrame, cols: Sequence[str], key: str, time_col: str, length: str, slide: str) -> DataFrame:
    """Sliding windows put together from panes of one slide, so an event is aggregated once and only panes are copied.

    A window has ``length / slide`` panes, which meet as a list of that many entries. A stream keeps sums per pane, and that list
    per open window, as state.
    """
    pane = df.groupBy(F.window(time_col, slide).alias("pane"), F.col(key)).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), F.var_pop(c).alias("var")).alias(f"p_{c}") for c in cols],
    )
    # The windows of a pane are those of its last instant, which in a stream carries the watermark on to the second aggregate.
    spread = pane.select(F.window(F.window_time("pane"), length, slide).alias("w"), key, "n", *[f"p_{c}" for c in cols])
    met = spread.groupBy("w", key).agg(F.sum("n").alias("window_size"), *[F.collect_list(f"p_{c}").alias(f"p_{c}") for c in cols])

    def total(panes: Column, value) -> Column:
        return F.aggregate(panes, F.lit(0.0), lambda held, p: held + F.when(p["n"] > 0, value(p)).otherwise(0.0))

    out = {}
    for c in cols:
        n = total(F.col(f"p_{c}"), lambda p: p["n"].cast("double"))
        mean = F.try_divide(total(F.col(f"p_{c}"), lambda p: p["n"] * p["mean"]), n)
        out |= {f"n_{c}": n, f"mean_{c}": mean}
    met = met.withColumns(out)
    spreads = {
        f"var_{c}": F.try_divide(total(F.col(f"p_{c}"), lambda p, c=c: p["n"] * (p["var"] + (p["mean"] - F.col(f"mean_{c}")) * (p["mean"] - F.col(f"mean_{c}")))), F.col(f"n_{c}"))
        for c in cols
    }
    return met.withColumns(spreads)


def window_end_ms(window: Column) -> Column:
    return F.unix_millis(window["end"].cast("timestamp"))


def fill_gaps(stats: DataFrame, *, length_ms: int, width: int, key: str = "node_name") -> DataFrame:
    """Add a zero vector for every window a node has no row for, between its first and last one.

    A node's calendar is first cut into parts of ``CALENDAR_SLOTS`` windows, which are dealt out before they are written out.
    """
    step, part = F.lit(length_ms).cast("long"), F.lit(length_ms * CALENDAR_SLOTS).cast("long")
    spans = stats.groupBy(key).agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    parts = spans.select(key, "hi", F.explode(F.sequence("lo", "hi", part)).alias("begin")).repartition(key, "begin")
    calendar = parts.select(key, F.explode(F.sequence("begin", F.least("hi", F.col("begin") + part - step), step)).alias("timestamp"))
    return calendar.join(stats, [key, "timestamp"], "left").select(
        "timestamp",
        key,
        F.coalesce("window_size", F.lit(0).cast("long")).alias("window_size"),
        F.coalesce("features", F.array_repeat(F.lit(0.0), width)).alias("features"),
    )
