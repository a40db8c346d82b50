"""Packing along a space-filling curve: documents near each other in token space share sequences.

A document's hashed token vector is projected at random to a short one, and that to the few principal axes of all documents. Each axis is
cut into equally full cells; a cell's place on the Hilbert curve orders the documents. Ranges of the curve go to tasks, which lay their documents end to end and cut the
stream into full sequences. Texts are encoded once; their ids are stored in parts of bounded size and shuffled by curve range.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telewarden.functions.vectors import as_matrix, multiply
from telewarden.llm import pieces
from telewarden.llm.token_counts import byte_slices
from telewarden.session import cut_lineage

#: Entries of a hashed token vector, of its random projection, and axes of the curve.
BUCKETS, SHORT, DIMENSIONS = 4_096, 32, 4
#: Cells of an axis, as a power of two.
CELL_BITS = 8
SEED = 13
#: Hashes an id: the upper 12 bits of its product with an odd number.
_SPREAD, _SHIFT = np.uint32(2_654_435_769), np.uint32(32 - 12)
#: Ids of a stored part; a long document is many rows.
PART_TOKENS = 65_536
#: Precision of the cells' borders, as the inverse of the share of documents they may be off by.
BORDER_PRECISION = 10_000
#: Sequences of a task are numbered from the task's number times this.
TASK_SEQUENCES = 1 << 40

_PART_SCHEMA = "row long, doc_id long, doc_tokens long, start long, ids binary, place array<double>"
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PIECE_TYPES = [pa.int64()] * 7
_PIECE_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def projection(seed: int = SEED) -> np.ndarray:
    """Seeded normal directions, one row per entry of the hashed vector; workers draw them anew instead of receiving them."""
    return np.random.default_rng(seed).normal(size=(BUCKETS, SHORT))


def placed(ids: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """The projected token vector of a document, of length one before projection: logarithms of counts of hashed ids. No ids give zeros."""
    counts = np.bincount((ids * _SPREAD) >> _SHIFT, minlength=BUCKETS)
    met = np.flatnonzero(counts)
    if not len(met):
        return np.zeros(directions.shape[1])
    weights = np.log1p(counts[met])
    return weights @ directions[met] / np.sqrt(weights @ weights)


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell numbers, all rows at once (Skilling's transform, from axes to the curve)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(n):
            high = (x[i] & bit) != 0
            swapped = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swapped)
            x[i] ^= swapped if i else 0
        bit >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turned, bit = np.zeros_like(x[0]), 1 << (bits - 1)
    while bit > 1:
        turned ^= np.where(x[n - 1] & bit, bit - 1, 0)
        bit >>= 1
    x ^= turned
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def encode_parts(docs: DataFrame, path: str, end_id: int, *, spaces_kept: bool = True, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """Ids of every document, ``end_id`` last, in parts of at most ``PART_TOKENS``, each with the document's place in the projection."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, directions = pieces.encoder(path, spaces_kept=spaces_kept, lengths_only=False), projection(seed)
        tail = int(end_id).to_bytes(4, "little")
        for whole in batches:
            for batch in byte_slices(whole, "text"):
                rows = []
                encoded = encoder(batch.column("text").to_pylist())
                for row, doc_id, ids in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), encoded, strict=True):
                    data, place = memoryview(ids + tail), placed(np.frombuffer(ids, "<u4"), directions).tolist()
                    size = len(data) // 4
                    for a in range(0, size, PART_TOKENS):
                        rows.append((row, doc_id, size, a, _narrow(data[4 * a : 4 * (a + PART_TOKENS)]), place))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.float64())]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "doc_tokens", "start", "ids", "place"])

    chosen = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(encode, _PART_SCHEMA)


def _narrow(ids: memoryview) -> bytes:
    """Ids in two bytes each behind a 2, or as they are behind a 4 where one needs more."""
    wide = np.frombuffer(ids, "<u4")
    return b"\x02" + wide.astype("<u2").tobytes() if not len(wide) or wide.max() < 1 << 16 else b"\x04" + wide.tobytes()


def _widen(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, f"<u{stored[0]}", offset=1).astype("<u4")


def principal_axes(places: DataFrame) -> np.ndarray:
    """The leading principal axes of ``place`` over all rows, in columns; moments are summed per task, then per cell of their matrix."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((SHORT + 1, SHORT + 1))
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), as_matrix(batch.column("place"), SHORT)])
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["cell", "value"])

    summed = places.select("place").mapInArrow(moments, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    total = np.zeros((SHORT + 1) ** 2)
    for r in summed:
        total[r["cell"]] = r["value"]
    total = total.reshape(SHORT + 1, SHORT + 1)
    n, mean = max(total[0, 0], 1.0), total[0, 1:] / max(total[0, 0], 1.0)
    _, axes = np.linalg.eigh(total[1:, 1:] / n - np.outer(mean, mean))
    return axes[:, : -DIMENSIONS - 1 : -1]


def curve_place(parts: DataFrame) -> Column:
    """Hilbert key of the documents: each axis is cut into cells that hold equally many documents."""
    documents = parts.where("start = 0")
    axes = principal_axes(documents)
    shares = [i / (1 << CELL_BITS) for i in range(1, 1 << CELL_BITS)]
    at_axes = documents.select(multiply(F.col("place"), axes).alias("at"))
    borders = [F.percentile_approx(F.col("at")[d], shares, BORDER_PRECISION).alias(f"d{d}") for d in range(DIMENSIONS)]
    found = at_axes.agg(*borders).first()
    cuts = [np.array(c if c is not None else [], np.float64) for c in found]

    @F.arrow_udf("long")
    def key(place: pa.Array) -> pa.Array:
        at = as_matrix(place, SHORT) @ axes
        cells = np.stack([np.searchsorted(c, at[:, d], side="right") for d, c in enumerate(cuts)], axis=1)
        return pa.array(hilbert_key(cells, CELL_BITS))

    return key("place")


def powers_of_two(tokens: int) -> list[int]:
    """Falling powers of two that add up to ``tokens``."""
    return [1 << b for b in range(tokens.bit_length() - 1, -1, -1) if tokens >> b & 1]


def _pieces_of(held: list[tuple[int, int, int, int, np.ndarray]], sizes: Sequence[int], first: int) -> list[tuple]:
    """Rows of the pieces of consecutive sequences of ``sizes`` tokens; parts that continue one another become one piece."""
    joined: list[list] = []
    for row, doc_id, doc_tokens, start, ids in held:
        if joined and joined[-1][0] == row and joined[-1][3] + len(joined[-1][4]) == start:
            joined[-1][4] = np.concatenate([joined[-1][4], ids])
        else:
            joined.append([row, doc_id, doc_tokens, start, ids])
    rows, sequence, offset = [], 0, 0
    for _, doc_id, doc_tokens, start, ids in joined:
        used = 0
        while used < len(ids):
            taken = min(len(ids) - used, sizes[sequence] - offset)
            crc = zlib.crc32(ids[used : used + taken].tobytes())
            rows.append((doc_id, start + used, taken, crc, doc_tokens, first + sequence, offset))
            used, offset = used + taken, offset + taken
            if offset == sizes[sequence]:
                sequence, offset = sequence + 1, 0
    return rows


def pack(docs: DataFrame, path: str, end_id: int, capacity: int, *, spaces_kept: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of each piece of each document.

    Every sequence is full but for those at the end of a task's stretch of the curve, whose tokens are cut into sequences of
    falling powers of two, so that nothing is padded. A null or empty text is its end id alone; copies lie next to each other, repeated rows
    each in their own pieces; an empty table gives an empty one; other columns are not read. Ids are stored once, in parts that
    bound what a row holds, and shuffled once; equal places on the curve are split by row, so a hot one is many tasks.
    """
    parts = cut_lineage(encode_parts(docs, path, end_id, spaces_kept=spaces_kept, id_col=id_col, text_col=text_col), "token-parts")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, tokens = TaskContext.get().partitionId() * TASK_SEQUENCES, [], 0
        for batch in batches:
            rows = []
            for row, doc_id, doc_tokens, start, stored in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "doc_tokens", "start", "ids")), strict=True):
                ids, used = _widen(stored), 0
                while used < len(ids):
                    part = ids[used : used + capacity - tokens]
                    held.append((row, doc_id, doc_tokens, start + used, part))
                    used, tokens = used + len(part), tokens + len(part)
                    if tokens == capacity:
                        rows += _pieces_of(held, [capacity], first)
                        first, held, tokens = first + 1, [], 0
            if rows:
                yield _piece_batch(rows)
        if held:
            yield _piece_batch(_pieces_of(held, powers_of_two(tokens), first))

    order = ["key", "row", "start"]
    ordered = parts.withColumn("key", curve_place(parts)).drop("place").repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.mapInArrow(fill, PIECE_SCHEMA)


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PIECE_TYPES, strict=True)]
    return pa.RecordBatch.from_arrays(columns, _PIECE_NAMES)
