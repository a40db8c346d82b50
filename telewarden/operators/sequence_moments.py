"""Work on sliding sequences without ever storing one: rows of an entity, cut into overlapping stretches, pass through tasks once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telewarden.functions.ordered import CHUNK_ROWS, frame_chunks
from telewarden.functions.vector_sums import sum_by_key
from telewarden.functions.vectors import as_matrix, is_complete
from telewarden.session import cut_lineage

#: Sequences whose steps are laid side by side at once, in numbers; scoring them holds about five times that.
BLOCK_NUMBERS = 1 << 17
#: Rows of a stretch that scoring holds at once, besides those before them and what an Arrow batch has more.
PIECE_ROWS = 1 << 13
_GROUP, _STEP, _MARK = "_tw_group", "_tw_step", "_tw_mark"


def stretches(
    df: DataFrame, features: Column, *, keys: Sequence[str], order: Sequence[str], length: int, keep: Sequence[str] = (), marked: Column | None = None, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """The stored rows of ``df`` in stretches of consecutive rows, each with the ``length - 1`` rows before it.

    ``keep`` names the columns that results are to carry, ``marked`` the rows whose sequences count (all by default). A table of about the size
    of ``df``: only the rows at borders are there twice.
    """
    mark = F.lit(True) if marked is None else F.coalesce(marked, F.lit(False))
    chosen = df.select(*dict.fromkeys([*keys, *order, *keep]), features.cast("array<double>").alias(_STEP), mark.alias(_MARK))
    chunks = frame_chunks(chosen, keys, order, order[0], length, chunk_rows=chunk_rows)
    group = F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys], F.col("_chunk"))
    return cut_lineage(chunks.select(*keep, *[F.col(k).alias(f"_tw_k{i}") for i, k in enumerate(keys)], "_chunk", "_own", "pos", group.alias(_GROUP), _STEP, _MARK), "stretches")


def sequence_ends(stored: DataFrame, length: int) -> DataFrame:
    """The rows of ``stretches`` that end a sequence, complete or not, each once."""
    return stored.where(F.col("_own") & (F.col("pos") >= length - 1))


def marked(stored: DataFrame, mark: Column) -> DataFrame:
    """The same stretches with other rows marked, by kept columns."""
    return stored.withColumn(_MARK, F.coalesce(mark, F.lit(False)))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.Table]]:
    """Sorted rows as parts of stretches, and whether a part goes on with the one before: a stretch ends where the group changes or a
    position is missing."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        group, pos = batch.column(_GROUP).to_numpy(), batch.column("pos").to_numpy()
        cuts = np.flatnonzero((group[1:] != group[:-1]) | (pos[1:] != pos[:-1] + 1)) + 1
        bounds = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield not a and (group[0], pos[0]) == last, pa.Table.from_batches([batch.slice(a, b - a)])
        last = (group[-1], pos[-1] + 1)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole stretches."""
    held: list[pa.Table] = []
    for goes_on, part in _parts(batches):
        if held and not goes_on:
            yield pa.concat_tables(held).combine_chunks()
            held = []
        held.append(part)
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _pieces(tables: Iterator[tuple[bool, pa.Table]], length: int, rows: int) -> Iterator[pa.Table]:
    """Stretches in pieces of about ``rows`` rows, each with the ``length - 1`` before them, so that every sequence ends in just one."""
    held: list[pa.Table] = []
    n = 0
    for goes_on, part in tables:
        if not goes_on:
            if held:
                yield pa.concat_tables(held).combine_chunks()
            held, n = [], 0
        held.append(part)
        n += part.num_rows
        if n >= rows + length - 1:
            whole = pa.concat_tables(held).combine_chunks()
            yield whole
            # Copied, as a slice would keep the whole piece.
            tail = whole.slice(n - (length - 1)).take(pa.array(range(length - 1), pa.int64()))
            held, n = [tail], length - 1
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _in_order(stored: DataFrame) -> DataFrame:
    keys = [c for c in stored.columns if c.startswith("_tw_k")]
    return stored.repartition(_GROUP).sortWithinPartitions(*keys, "_chunk", "pos").drop(*keys, "_chunk", "_own")


def _ends(table: pa.Table, width: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a stretch as a matrix, and which of its sequences, by first row, are complete and wanted."""
    steps = _matrix(table.column(_STEP).combine_chunks(), width)
    if len(steps) < length:
        return steps, np.zeros(0, bool)
    bad = np.concatenate([[0], np.cumsum(np.isnan(steps).any(axis=1))])
    wanted = table.column(_MARK).to_numpy()[length - 1 :]
    return steps, (bad[length:] == bad[:-length]) & wanted


def _matrix(cells: pa.ListArray, width: int) -> np.ndarray:
    """Rows of another width count as missing."""
    sizes = cells.value_lengths().fill_null(0).to_numpy()
    if (sizes == width).all():
        return as_matrix(cells, width)
    out = np.full((len(cells), width), np.nan)
    right = np.flatnonzero(sizes == width)
    out[right] = as_matrix(cells.take(pa.array(right)), width)
    return out


def _add_run(x: np.ndarray, starts: int, length: int, sums: np.ndarray, products: np.ndarray) -> None:
    """Add all sequences of consecutive starts. Products of steps ``i`` and ``j`` differ from those of the steps before by one row that
    leaves and one that enters, so only products with the first step are multiplied out, one lag at a time."""
    width = x.shape[1]
    first = x[:starts].sum(axis=0)
    row = np.concatenate([x[:starts].T @ x[k : k + starts] for k in range(length)], axis=1)
    for i in range(length):
        if i:
            out, into = x[i - 1], x[starts + i - 1]
            first = first - out + into
            row = row[:, :-width] - np.outer(out, x[i - 1 : length - 1].ravel()) + np.outer(into, x[starts + i - 1 : starts + length - 1].ravel())
        sums[i * width : (i + 1) * width] += first
        products[i * width : (i + 1) * width, i * width :] += row


def complete_sequences(stored: DataFrame, length: int) -> bool:
    """Whether any marked sequence has all its entries."""
    found = map_sequences(stored, step_width(stored), length, lambda rows: np.zeros(len(rows)), "found")
    return not found.where("found is not null").isEmpty()


def sequence_moments(stored: DataFrame, width: int, length: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and covariance of the flattened complete, marked sequences of ``stretches``.

    A task adds up one matrix of ``(length * width)`` squared over all its stretches, and only the driver's copy of their sum leaves the
    executors. Products are taken around the mean row, so large levels cost no digits.
    """
    size = length * width
    level = _mean_step(stored, width)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums, products = 0, np.zeros(size), np.zeros((size, size))
        for table in _grouped(batches):
            steps, use = _ends(table, width, length)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], use.view(np.int8), [0]])))
            for a, b in edges.reshape(-1, 2):
                _add_run(steps[a : b + length - 1] - level, int(b - a), length, sums, products)
                count += int(b - a)
        if count:
            rows = np.concatenate([products, sums[None], np.full((1, size), float(count))])
            cells = pa.ListArray.from_arrays(np.arange(size + 3, dtype=np.int32) * size, rows.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(range(size + 2), pa.int32()), cells], ["i", "v"])

    partial = _in_order(stored.select(*[c for c in stored.columns if c.startswith("_tw_k")], "_chunk", "pos", _GROUP, _STEP, _MARK))
    total = np.zeros((size + 2, size))
    met = sum_by_key(partial.mapInArrow(moments, "i int, v array<double>"), ["i"], "v", size, combine=False)
    for r in met.select("i", "total").toLocalIterator():
        total[r["i"]] = r["total"]
    count = int(total[size + 1, 0])
    if not count:
        raise ValueError("no complete sequence to fit on")
    mean = total[size] / count
    upper = np.triu(total[:size])
    products = upper + np.triu(upper, 1).T
    covariance = (products - count * np.outer(mean, mean)) / max(count - 1, 1)
    return count, mean + np.tile(level, length), covariance


def _mean_step(stored: DataFrame, width: int) -> np.ndarray:
    """Mean of the complete rows, entry by entry."""
    complete = stored.where(is_complete(F.col(_STEP)) & (F.size(_STEP) == width))
    found = complete.agg(*[F.avg(F.col(_STEP)[j]) for j in range(width)]).first()
    return np.array([x or 0.0 for x in found])


def step_width(stored: DataFrame) -> int:
    found = stored.agg(F.max(F.size(_STEP))).first()[0]
    if not found or found < 1:
        raise ValueError("no feature vector to fit on")
    return int(found)


def map_sequences(stored: DataFrame, width: int, length: int, value: Callable[[np.ndarray], np.ndarray], into: str) -> DataFrame:
    """The kept columns of every marked row that ends a sequence, and ``value`` of its flattened steps; null for an incomplete one.

    ``value`` gets a bounded number of sequences, side by side as rows of a matrix, and gives a number for each.
    """
    own = {c for c in stored.columns if c.startswith("_tw_k")} | {"_chunk", "_own", "pos", _GROUP, _STEP, _MARK}
    keep = [c for c in stored.columns if c not in own]
    block, piece = max(1, BLOCK_NUMBERS // (width * length)), PIECE_ROWS

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _pieces(_parts(batches), length, piece):
            steps, use = _ends(table, width, length)
            if not len(use):
                continue
            windows = np.lib.stride_tricks.sliding_window_view(steps, length, axis=0).transpose(0, 2, 1)
            out = np.full(len(use), np.nan)
            complete = np.flatnonzero(use)
            for a in range(0, len(complete), block):
                rows = complete[a : a + block]
                out[rows] = value(windows[rows].reshape(len(rows), -1))
            marked = table.column(_MARK).combine_chunks().slice(length - 1)
            found = table.select(keep).slice(length - 1).append_column(into, pa.array(out, mask=np.isnan(out))).filter(marked)
            yield from found.combine_chunks().to_batches()

    schema = T.StructType([*[f for f in stored.schema.fields if f.name in keep], T.StructField(into, T.DoubleType())])
    return _in_order(stored).mapInArrow(scored, schema)

