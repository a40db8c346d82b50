"""Exact interpolated quantiles that do not hold a column in one task."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IN_MEMORY = 1_000_000
_ACCURACY = 10_000


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], in_memory: int = IN_MEMORY) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles per column, ignoring nulls.

    Tables of at most ``in_memory`` cells use the built-in aggregate. On larger ones a bounded
    sketch brackets the two order statistics each quantile lies between, exact counts
    confirm the brackets, and this repeats inside them until few distinct values are left to
    select from. Every pass serves all columns and quantiles at once; the driver sees
    a few numbers per quantile.
    """
    cols, probs = list(cols), [float(p) for p in probs]
    sizes = df.agg(*[F.count(F.col(c)).alias(c) for c in cols]).first()
    allowed = in_memory // max(len(cols), 1)
    small = [c for c in cols if sizes[c] <= allowed]
    out: dict[str, list[float | None]] = {}
    if small:
        row = df.agg(*[F.percentile(F.col(c), F.array(*[F.lit(p) for p in probs])).alias(c) for c in small]).first()
        out.update({c: list(row[c]) if row[c] is not None else [None] * len(probs) for c in small})
    ranks = {(c, p): _ranks(p, sizes[c]) for c in cols if c not in out for p in probs}
    brackets = [_Bracket(c, rank, sizes[c]) for c, rank in dict.fromkeys((c, r) for (c, _), (first, second, _) in ranks.items() for r in (first, second))]
    if brackets:
        _narrow(df, brackets, max(1, in_memory // len(brackets)))
        found = _select(df, brackets)
        value = lambda c, first, second, part: found[c, first] + (found[c, second] - found[c, first]) * part if part else found[c, first]
        out.update({c: [value(c, *ranks[c, p]) for p in probs] for c in cols if c not in out})
    return out


def nth_smallest(df: DataFrame, col: str, rank: int, in_memory: int = IN_MEMORY):
    """The value at a 0-based rank of a numeric column without nulls, in the column's own type."""
    bracket = _Bracket(col, rank, df.count(), cast=None)
    _narrow(df, [bracket], in_memory)
    return _select(df, [bracket])[col, rank]


def quantile_table(df: DataFrame, cols: Sequence[str], probs: Sequence[float], in_memory: int = IN_MEMORY) -> DataFrame:
    """The same as a one-row DataFrame with an array per column."""
    found = exact_quantiles(df, cols, probs, in_memory)
    schema = ", ".join(f"`{c}` array<double>" for c in cols)
    return df.sparkSession.createDataFrame([tuple(found[c] for c in cols)], schema)


def _ranks(prob: float, n: int) -> tuple[int, int, float]:
    """The two 0-based ranks a quantile lies between, and how far it is on the way."""
    first = int(prob * (n - 1))
    return first, min(first + 1, n - 1), prob * (n - 1) - first


@dataclass
class _Bracket:
    """A value range known to hold the 0-based ``rank`` of a column; without ``low`` the whole column."""

    col: str
    rank: int
    inside: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    open: bool = False  # whether both ends are left out
    margin: float = 4.0 / _ACCURACY
    cast: str | None = "double"

    def value(self) -> Column:
        return F.col(self.col).cast(self.cast) if self.cast else F.col(self.col)

    def holds(self) -> Column:
        if self.low is None:
            return self.value().isNotNull()
        return (self.value() > self.low) & (self.value() < self.high) if self.open else self.value().between(self.low, self.high)

    def single(self) -> bool:
        return self.low is not None and self.low == self.high and not self.open

    def shares(self) -> list[float]:
        at = (self.rank - self.below) / max(self.inside - 1, 1)
        return [max(0.0, at - self.margin), min(1.0, at + self.margin)]


def _narrow(df: DataFrame, brackets: list[_Bracket], enough: int) -> None:
    """Shrink brackets until each holds few rows or one value.

    The sketch proposes ends and exact counts confirm them. If they don't shrink a bracket, its two ends are values with many rows
    each: the rank is on one of them, or strictly between, where few rows are left.
    """
    while todo := [b for b in brackets if b.inside > enough and not b.single()]:
        sketch = df.agg(
            *[
                F.percentile_approx(F.when(b.holds(), b.value()), F.array(*[F.lit(s) for s in b.shares()]), _ACCURACY).alias(f"b{i}")
                for i, b in enumerate(todo)
            ]
        ).first()
        edges = [sketch[f"b{i}"] for i in range(len(todo))]
        counts = df.agg(
            *[F.count_if(b.value() < lo).alias(f"lt{i}") for i, (b, (lo, _)) in enumerate(zip(todo, edges))],
            *[F.count_if(b.value() == lo).alias(f"lo{i}") for i, (b, (lo, _)) in enumerate(zip(todo, edges))],
            *[F.count_if(b.value() == hi).alias(f"hi{i}") for i, (b, (_, hi)) in enumerate(zip(todo, edges))],
            *[F.count_if(b.value().between(lo, hi)).alias(f"in{i}") for i, (b, (lo, hi)) in enumerate(zip(todo, edges))],
        ).first()
        for i, (b, (lo, hi)) in enumerate(zip(todo, edges)):
            below, inside, at_low, at_high = (counts[f"{k}{i}"] for k in ("lt", "in", "lo", "hi"))
            if not below <= b.rank < below + inside:
                b.margin *= 4
            elif b.rank < below + at_low:
                b.low = b.high = lo
                b.below, b.inside, b.open = below, at_low, False
            elif b.rank >= below + inside - at_high:
                b.low = b.high = hi
                b.below, b.inside, b.open = below + inside - at_high, at_high, False
            else:
                b.low, b.high, b.open = lo, hi, True
                b.below, b.inside = below + at_low, inside - at_low - at_high


def _select(df: DataFrame, brackets: list[_Bracket]) -> dict[tuple[str, int], float]:
    """Pick the rank of every bracket from counts of equal values."""
    found = {(b.col, b.rank): b.low for b in brackets if b.single()}
    brackets = [b for b in brackets if not b.single()]
    if not brackets:
        return found
    tagged = [F.when(b.holds(), F.struct(F.lit(i).alias("b"), b.value().alias("v"))) for i, b in enumerate(brackets)]
    cells = df.select(F.explode(F.array_compact(F.array(*tagged))).alias("cell"))
    groups = cells.groupBy("cell.b", "cell.v").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = groups.withColumn("upto", F.sum("n").over(upto))
    local = F.element_at(F.array(*[F.lit(b.rank - b.below) for b in brackets]), F.col("b") + 1)
    hit = F.when((F.col("upto") > local) & (F.col("upto") - F.col("n") <= local), F.col("v"))
    for r in placed.groupBy("b").agg(F.min(hit).alias("v")).collect():  # one row per bracket
        b = brackets[r["b"]]
        found[b.col, b.rank] = r["v"]
    return found
