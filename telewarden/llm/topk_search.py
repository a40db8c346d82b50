"""Exact top-k search by integer inner product with block-at-a-time pruning.

A term is a dimension with a sign. Rows are put into groups of similar vectors, and a group is cut into blocks of consecutive rows
that keep a forward index, the integer rows themselves, and each term's maximum. For a query the summed term maxima bound every
score in a block; it goes through the blocks of a group by falling bound and stops when a bound falls below the k-th best
score it has seen. A bounded sample of rows gives that score a start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telewarden.session import cut_lineage

#: Components are multiplied by this and rounded down.
SCALE = 64
#: Rows of a block, of a group and of a query tile.
BLOCK_ROWS, GROUP_ROWS, TILE_ROWS = 128, 16_384, 2_048
#: Rows sampled by hash, for the first bounds and the cells of similar vectors.
SAMPLE_ROWS, CELLS, CELL_ROUNDS = 4_096, 32, 5
_LONG = np.iinfo(np.int64)


def quantised(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``uid, vec_id, v``: rows whose vectors have finite components only, with an id per row, written to a table."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    kept = df.where(v.isNotNull() & finite & F.col(id_col).isNotNull())
    return cut_lineage(kept.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("vec_id"), whole.alias("v")), "vectors")


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    flat = np.asarray(pa.compute.list_flatten(column), np.int64)
    return flat.reshape(rows, -1) if rows else np.zeros((0, 0), np.int64)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact ``a @ b.T`` as long, clipped to its range: in doubles while every partial sum is a whole number they can hold."""
    most = np.abs(a.astype(np.float64)).max(initial=0) * np.abs(b.astype(np.float64)).max(initial=0) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, _LONG.min, _LONG.max).astype(np.int64)


def _cells(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres of a few rounds of k-means over the sample."""
    centres = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)].astype(float)
    for _ in range(CELL_ROUNDS):
        own = _nearest(sample, centres)
        for k in np.unique(own):
            centres[k] = sample[own == k].mean(axis=0)
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (rows.astype(float) @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Width, row numbers and matrix of the batch's rows of each vector length."""
    widths = np.asarray(pa.compute.list_value_length(batch.column("v")))
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        yield int(width), rows, _matrix(batch.column("v").take(pa.array(rows)), len(rows))


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def search_blocks(queries: np.ndarray, query_uids: np.ndarray, floor: np.ndarray, blocks: list[dict], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query the ids and scores of its best ``k`` rows of one group, of those that reach ``floor``.

    In each turn a query scores the block of its next highest bound; queries at the same block are scored together. A block is
    skipped only if its bound is below the k-th score, so ties are kept.
    """
    high, low = np.stack([b["high"] for b in blocks]), np.stack([b["low"] for b in blocks])
    positive, negative = np.maximum(queries, 0), np.minimum(queries, 0)
    largest = np.abs(queries.astype(float)).max(initial=0) * max(np.abs(high.astype(float)).max(initial=0), np.abs(low.astype(float)).max(initial=0))
    if largest * max(1, queries.shape[1]) < 2**52:
        bounds = _products(positive, high) + _products(negative, low)
    else:
        bounds = np.full((len(queries), len(blocks)), _LONG.max)  # too large to bound: every block is scored
    order = np.argsort(-bounds, axis=1, kind="stable")
    kth = floor.copy()
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries]
    live = np.arange(len(queries))
    for turn in range(len(blocks)):
        next_ = order[live, turn]
        going = bounds[live, next_] >= kth[live]
        live, next_ = live[going], next_[going]
        if not len(live):
            break
        for b in np.unique(next_):
            who, block = live[next_ == b], blocks[b]
            scores = _products(queries[who], block["rows"])
            hits = (scores >= kth[who, None]) & (block["uids"][None, :] != query_uids[who, None])
            for i in np.flatnonzero(hits.any(axis=1)):
                q = who[i]
                ids = np.concatenate([best[q][0], block["ids"][hits[i]]])
                own = np.concatenate([best[q][1], scores[i][hits[i]]])
                keep = _top(own, ids, k)
                best[q] = ids[keep], own[keep]
                if len(keep) == k:
                    kth[q] = max(kth[q], own[keep[-1]])
    return best


def top_k(df: DataFrame, is_query: Column, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of highest inner product for each row where ``is_query`` holds.

    Each component x counts as ``floor(64 x)``; ties go to the smaller id. ``is_query`` may use ``vec_id``. Vectors that are null or hold a null or
    non-finite component take no part, nor do rows without an id; only vectors of one length are compared. A row is not its
    own candidate, but a repeated row is one. Scores beyond a long are clipped. An empty table gives an empty one.

    A tile of queries meets a group of rows in one task, so each row is sent once per tile of queries and each query once per
    group; both sizes are parameters. Identical vectors that fill many groups are split by hash like others.
    """
    spark = df.sparkSession
    rows = quantised(df, id_col, vector_col)
    drawn = rows.orderBy(F.xxhash64("vec_id"), "uid").limit(SAMPLE_ROWS).collect()
    samples: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for width in {len(r["v"]) for r in drawn}:
        own = [r for r in drawn if len(r["v"]) == width]
        samples[width] = np.array([r["uid"] for r in own], np.int64), np.array([r["v"] for r in own], np.int64).reshape(len(own), width)
    centres = {width: _cells(sample, CELLS) for width, (_, sample) in samples.items() if width}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int32)
            for width, at, matrix in _by_width(batch):
                if width in centres:
                    cell[at] = _nearest(matrix, centres[width])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    celled = rows.mapInArrow(assign, "uid long, vec_id long, v array<long>, cell int").withColumn("width", F.size("v"))
    celled = cut_lineage(celled, "cells")
    # A cell of one length is split into groups of bounded size; groups of a length are numbered from 0.
    sizes = celled.groupBy("width", "cell").agg(F.count(F.lit(1)).alias("n"))
    splits = F.ceil(F.col("n") / GROUP_ROWS).cast("int")
    ordered = Window.partitionBy("width").orderBy("cell")
    ranges = sizes.select(
        "width", "cell", splits.alias("splits"), (F.sum(splits).over(ordered) - splits).alias("first"), F.sum(splits).over(Window.partitionBy("width")).alias("groups")
    )
    queries = celled.where(is_query)
    tiles = max(1, -(-queries.count() // TILE_ROWS))
    block_type = "width int, grp long, tile int, uids binary, ids binary, rows binary, high binary, low binary"

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("vec_id", "ascending"), ("uid", "ascending")])
        ids, uids = table.column("vec_id").to_numpy(), table.column("uid").to_numpy()
        matrix = _matrix(table.column("v").combine_chunks(), len(ids))
        out = []
        for a in range(0, len(ids), BLOCK_ROWS):
            part = matrix[a : a + BLOCK_ROWS]
            out.append((uids[a : a + BLOCK_ROWS].tobytes(), ids[a : a + BLOCK_ROWS].tobytes(), part.tobytes(), part.max(axis=0).tobytes(), part.min(axis=0).tobytes()))
        width, group, n = table.column("width")[0].as_py(), table.column("grp")[0].as_py(), len(out)
        columns = [pa.array([width] * n, pa.int32()), pa.array([group] * n, pa.int64()), *[pa.array(c, pa.binary()) for c in zip(*out, strict=True)]]
        return pa.Table.from_arrays(columns, ["width", "grp", "uids", "ids", "rows", "high", "low"])

    grouped = celled.join(F.broadcast(ranges), ["width", "cell"]).withColumn("grp", F.col("first") + F.pmod(F.xxhash64("uid"), F.col("splits")))
    blocks = grouped.select("width", "grp", "uid", "vec_id", "v").groupBy("width", "grp").applyInArrow(pack, block_type.replace("tile int, ", ""))
    blocks = blocks.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floor = np.full(batch.num_rows, _LONG.min)
            uid = batch.column("uid").to_numpy()
            for width, at, matrix in _by_width(batch):
                if width in samples and len(samples[width][0]) > k:
                    own, sample = samples[width]
                    scores = np.where(own[None, :] == uid[at, None], _LONG.min, _products(matrix, sample))
                    floor[at] = np.partition(scores, len(own) - k, axis=1)[:, len(own) - k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor)], [*batch.schema.names, "floor"])

    asked = queries.select("uid", "vec_id", "v", "width").mapInArrow(start, "uid long, vec_id long, v array<long>, width int, floor long")
    asked = asked.withColumn("tile", F.pmod(F.xxhash64("uid"), F.lit(tiles)).cast("int"))
    count = ranges.groupBy("width").agg(F.max("groups").alias("groups"))
    asked = asked.join(F.broadcast(count), "width").withColumn("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_uid", "query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.int64())] * 4, names)
        uids, ids = left.column("uid").to_numpy(), left.column("vec_id").to_numpy()
        matrix = _matrix(left.column("v").combine_chunks(), len(ids))
        width = matrix.shape[1]
        packed = []
        for row in right.to_pylist():
            numbers = {c: np.frombuffer(row[c], np.int64) for c in ("uids", "ids", "rows", "high", "low")}
            packed.append(numbers | {"rows": numbers["rows"].reshape(len(numbers["ids"]), width)})
        found = search_blocks(matrix, uids, left.column("floor").to_numpy(), packed, k)
        n = [len(i) for i, _ in found]
        arrays = [np.repeat(uids, n), np.repeat(ids, n), np.concatenate([i for i, _ in found]), np.concatenate([s for _, s in found])]
        return pa.Table.from_arrays([pa.array(a) for a in arrays], names)

    key = ["width", "grp", "tile"]
    pairs = asked.groupBy(*key).cogroup(blocks.groupBy(*key))
    found = pairs.applyInArrow(search, "query_uid long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_uid").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
