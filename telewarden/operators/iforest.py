"""Isolation forest: distributed sampling, one small task per tree, broadcast scoring."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telewarden import schemas
from telewarden.functions.quantiles import exact_quantiles
from telewarden.functions.skew import hash_subsamples
from telewarden.functions.vectors import as_matrix, as_numbers, is_complete, stack_arrays
from telewarden.operators.ensemble import fixed_minmax
from telewarden.session import cut_lineage, small_table

if TYPE_CHECKING:  # workers that only score are spared its 40 MB
    import pandas as pd

TREES, SAMPLE, CONTAMINATION, SEED = 150, 256, 0.05, 42
_EULER = 0.5772156649015329


def mean_path(n: float) -> float:
    """Average unsuccessful search depth in a binary tree of ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + _EULER) - 2.0 * (n - 1.0) / n


def grow_tree(points: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Random axis cuts until single points, equal points or the depth limit; at most ``2 * len(points)`` nodes."""
    nodes: list[list] = []
    todo = [(np.arange(len(points)), 0, None, None)]
    while todo:
        rows, depth, parent, side = todo.pop()
        me = len(nodes)
        nodes.append([me, -1, None, -1, -1, len(rows), depth])
        if parent is not None:
            nodes[parent][side] = me
        part = points[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            continue
        feature = int(rng.choice(usable))
        # A cut below the highest value leaves no side empty, however close the values are.
        cut = min(float(rng.uniform(low[feature], high[feature])), float(np.nextafter(high[feature], low[feature])))
        goes_left = part[:, feature] <= cut
        nodes[me][1:3] = [feature, cut]
        todo.append((rows[~goes_left], depth + 1, me, 4))
        todo.append((rows[goes_left], depth + 1, me, 3))
    return [tuple(n) for n in nodes]


@dataclass(frozen=True)
class IsolationForest:
    """Fitted trees (``FOREST_NODE`` rows) and the numbers needed to score.

    Cuts are drawn relative to a feature's range, so standardising features first would give the
    same trees; cuts are kept in the units of the data and no scaler is needed.
    """

    nodes: DataFrame
    width: int
    sample: int
    trees: int
    offset: float | None = None
    low: float | None = None
    high: float | None = None

    def raw_score(self, features: str | Column) -> Column:
        """``-2 ** (-E[h] / c(sample))``: the more negative, the more anomalous."""
        forest = self.nodes.sparkSession.sparkContext.broadcast(_pack(self.nodes.collect()))  # trees * 2 * sample rows at most
        width, scale = self.width, mean_path(self.sample)

        @F.arrow_udf("double")
        def score(batch: pa.Array) -> pa.Array:
            depth = _mean_depth(as_matrix(batch, width), forest.value)
            return as_numbers(-np.power(2.0, -depth / scale) if scale else np.where(np.isnan(depth), np.nan, -0.5))

        return score(F.col(features) if isinstance(features, str) else features)

    def decision(self, features: str | Column) -> Column:
        return self.raw_score(features) - F.lit(self.offset)

    def predict(self, df: DataFrame, features: str = "features", *, into: str = "label") -> DataFrame:
        """-1 for anomalies, 1 otherwise."""
        return df.withColumn("decision", self.decision(features)).withColumn(into, F.when(F.col("decision") < 0, -1).otherwise(1))

    def score(self, df: DataFrame, features: str = "features", *, into: str = "s_if", normalizer: str = "fitted") -> DataFrame:
        """Anomaly score in [0, 1], by the bounds seen at fit time or those of this batch."""
        raw = df.withColumn("_d", self.decision(features))
        if normalizer == "fitted":
            return raw.withColumn(into, fixed_minmax(F.col("_d"), self.low, self.high, invert=True)).drop("_d")
        from telewarden.operators.ensemble import minmax_score

        return minmax_score(raw, "_d", into, invert=True).drop("_d")

    def to_tables(self) -> dict[str, DataFrame]:
        spark = self.nodes.sparkSession
        row = (self.width, self.sample, self.trees, self.offset, self.low, self.high)
        meta = small_table(spark, [row], "width int, sample int, trees int, offset double, low double, high double")
        return {"forest": self.nodes, "forest_meta": meta}

    @staticmethod
    def from_tables(nodes: DataFrame, meta: DataFrame) -> IsolationForest:
        m = meta.first()
        return IsolationForest(nodes, m["width"], m["sample"], m["trees"], m["offset"], m["low"], m["high"])


def _pack(rows: Sequence) -> dict[str, np.ndarray]:
    """Trees as one set of flat arrays; leaves point to themselves."""
    rows = sorted(rows, key=lambda r: (r["tree_id"], r["node_id"]))
    first: dict[int, int] = {}
    for i, r in enumerate(rows):
        first.setdefault(r["tree_id"], i)
    leaf = np.array([r["feature"] < 0 for r in rows])
    own = np.arange(len(rows))
    base = np.array([first[r["tree_id"]] for r in rows])
    return {
        "roots": np.array(sorted(first.values())),
        "feature": np.array([max(r["feature"], 0) for r in rows]),
        "cut": np.array([np.inf if r["feature"] < 0 else r["threshold"] for r in rows]),
        "child": np.stack([np.where(leaf, own, base + np.array([r[side] for r in rows])) for side in ("left", "right")], axis=1).ravel(),
        "path": np.array([r["depth"] + mean_path(r["size"]) for r in rows]),
        "levels": max((r["depth"] for r in rows), default=0),
    }


def _mean_depth(x: np.ndarray, forest: dict[str, np.ndarray]) -> np.ndarray:
    """Mean path length per row of an Arrow batch, one tree level at a time for all rows."""
    n = len(x)
    columns, every, total = np.ascontiguousarray(x.T).ravel(), np.arange(n), np.zeros(n)
    for root in forest["roots"]:
        at = np.full(n, root)
        for _ in range(forest["levels"]):
            right = columns.take(forest["feature"].take(at) * n + every) > forest["cut"].take(at)
            at = forest["child"].take(2 * at + right)
        total += forest["path"].take(at)
    return np.where(np.isnan(x).any(axis=1), np.nan, total / max(len(forest["roots"]), 1))


def fit_iforest(
    df: DataFrame,
    *,
    id_col: str,
    features: str = "features",
    trees: int = TREES,
    sample: int = SAMPLE,
    contamination: float = CONTAMINATION,
    seed: int = SEED,
) -> IsolationForest:
    """Draw ``sample`` rows per tree by hash, grow trees in parallel, set the offset.

    A tree sees at most ``sample`` rows, whatever the table size; the same ids and seed give
    the same forest for any partitioning. Incomplete vectors are left out. Later passes only score, so pass a stored table if ``df`` is costly.
    """
    data = df.select(F.col(id_col), F.col(features).cast("array<double>").alias("features")).where(is_complete(F.col("features")))
    size = data.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("width")).first()
    if not size["n"]:
        raise ValueError("cannot fit a forest on an empty table")
    width, psi = size["width"], min(sample, size["n"])
    limit = math.ceil(math.log2(max(psi, 2)))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        import pandas as pd

        tree = int(group["tree_id"].iloc[0])
        ordered = group.sort_values("_rank")
        points = stack_arrays(ordered["features"], width)
        grown = grow_tree(points, np.random.default_rng([seed, tree]), limit)
        out = pd.DataFrame(grown, columns=["node_id", "feature", "threshold", "left", "right", "size", "depth"])
        out.insert(0, "tree_id", tree)
        return out

    drawn = hash_subsamples(data, id_col, trees, psi, seed, group_col="tree_id", n=size["n"])
    nodes = cut_lineage(drawn.groupBy("tree_id").applyInPandas(build, schemas.FOREST_NODE))
    raw = IsolationForest(nodes, width, psi, trees)
    scored = cut_lineage(data.select(raw.raw_score("features").alias("raw")))
    offset = exact_quantiles(scored, ["raw"], [contamination])["raw"][0]
    ends = scored.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).first()
    return IsolationForest(nodes, width, psi, trees, offset, ends["lo"] - offset, ends["hi"] - offset)


def fixed_forest_score(nodes: Iterable[tuple], features: Sequence[Column], sample: int) -> Column:
    """Raw score of a small given forest as one expression.

    ``nodes`` are ``(tree_id, node_id, feature, threshold, left, right, size)``; node 0 is the root.
    """
    trees: dict[int, dict[int, tuple]] = {}
    for tree_id, node_id, *rest in nodes:
        trees.setdefault(tree_id, {})[node_id] = tuple(rest)

    def depth(tree: dict[int, tuple], at: int, level: int) -> Column:
        feature, cut, left, right, size = tree[at]
        if feature < 0:
            return F.lit(float(level) + mean_path(size))
        return F.when(features[feature] <= F.lit(float(cut)), depth(tree, left, level + 1)).otherwise(depth(tree, right, level + 1))

    paths = [depth(t, 0, 0) for t in trees.values()]
    mean = sum(paths[1:], paths[0]) / F.lit(float(len(paths)))
    return -F.pow(F.lit(2.0), -mean / F.lit(mean_path(sample)))
