"""Packing of documents into token sequences by the configuration linear program.

A configuration is a multiset of piece lengths that fits one sequence. The program over the length histogram asks for the
fewest configurations that hold every piece. Its size depends on the sequence length alone, so it is solved on
the driver: multiplicative weights price the lengths, a knapsack dynamic program finds the configurations of highest
price that hold the longest open pieces, until every length is covered. The fractional solution is rounded, down first and then
up by largest fraction, and what is left gets a program of its own; the last few pieces are filled best-fit. Pieces
then find their place by their rank among pieces of equal length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telewarden.llm import pieces
from telewarden.llm.token_counts import byte_slices
from telewarden.session import cut_lineage

#: The price of a length is its share of a sequence to this power, so that long pieces come first and short ones are left to fill.
LENGTH_POWER = 1.02
#: How fast the price of a length falls with its cover.
LEARNING_RATE = 0.5
#: Configurations taken from one pricing, one for each of the longest lengths that are not covered.
COLUMNS = 64
#: Programs over what rounding leaves go on while each places at least this share of the tokens it is given.
LEAST_PLACED = 0.3
#: Pieces that share a ranking group: of one length and one hash bucket, at most about this many.
GROUP_ROWS = 100_000
LEAST_BUCKETS = 256

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, path: str, end_id: int, capacity: int, *, spaces_kept: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of each document. Only documents beyond ``capacity`` are cut; their first piece takes the remainder."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pieces.encoder(path, spaces_kept=spaces_kept, lengths_only=False)
        tail = int(end_id).to_bytes(4, "little")
        for whole in batches:
            for batch in byte_slices(whole, "text"):
                rows = []
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder(batch.column("text").to_pylist()), strict=True):
                    ids += tail
                    n = len(ids) // 4
                    bounds = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                    data = memoryview(ids)
                    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                        rows.append((doc_id, k, a, b - a, zlib.crc32(data[4 * a : 4 * b])))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECE_SCHEMA)


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """For every room, the length (as an index into the ascending ``lengths``) that comes first in its best filling; -1 leaves a token empty."""
    value = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1)
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), side="right").tolist()
    for room in range(1, capacity + 1):
        k = fitting[room]
        value[room] = value[room - 1]
        if k:
            worth = value[room - lengths[:k]] + prices[:k]
            best = int(worth.argmax())
            if worth[best] > value[room]:
                value[room], taken[room] = worth[best], best
    return taken


def best_filling(taken: np.ndarray, lengths: np.ndarray, room: int) -> dict[int, int]:
    """The multiset of lengths of highest total price that fits, by the table of ``knapsack``."""
    found: dict[int, int] = {}
    while room > 0:
        k = int(taken[room])
        if k < 0:
            room -= 1
        else:
            found[k] = found.get(k, 0) + 1
            room -= int(lengths[k])
    return found


def configuration_program(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> dict[tuple[tuple[int, int], ...], float]:
    """A fractional solution by multiplicative weights: configurations, as pairs of length index and copies, with their number of sequences.

    The price of a length is its share of a sequence, to ``LENGTH_POWER``, times ``exp(-LEARNING_RATE * cover)``. One knapsack serves the
    longest open lengths: each is completed to its best configuration of open lengths, used as often as the scarcest of them
    allows. So every configuration covers a length, and there are at most as many as lengths.
    """
    cover = np.zeros(len(lengths))
    used: dict[tuple[tuple[int, int], ...], float] = {}
    while True:
        open_ = np.flatnonzero(cover < 1)
        if not len(open_):
            return used
        own = lengths[open_]
        taken = knapsack(own, (own / capacity) ** LENGTH_POWER * np.exp(-LEARNING_RATE * cover[open_]), capacity)
        for first in range(len(own) - 1, max(-1, len(own) - 1 - COLUMNS), -1):
            found = best_filling(taken, own, capacity - int(own[first]))
            found[first] = found.get(first, 0) + 1
            at, n = open_[np.array(list(found))], np.array(list(found.values()))
            times = float(((1 - cover[at]) * counts[at] / n).min())
            if times > 0:  # none of them was covered since the pricing
                cover[at] += n * times / counts[at]
                cover[at[cover[at] > 1 - 1e-9]] = 1
                key = tuple(sorted(zip(at.tolist(), n.tolist(), strict=True)))
                used[key] = used.get(key, 0.0) + times


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Configurations for all that is left: the longest piece, then again and again the longest that still fits."""
    left = counts.copy()
    plan = []
    while left.any():
        room, found = capacity, {}
        while room > 0:
            fits = np.flatnonzero((left > 0) & (lengths <= room))
            fits = fits[[left[k] > found.get(int(k), 0) for k in fits]] if found else fits
            if not len(fits):
                break
            k = int(fits[-1])
            n = int(min(left[k] - found.get(k, 0), room // lengths[k]))
            found[k] = found.get(k, 0) + n
            room -= n * int(lengths[k])
        times = int(min(left[k] // n for k, n in found.items()))
        plan.append((found, times))
        for k, n in found.items():
            left[k] -= n * times
    return plan


def packing_plan(histogram: Mapping[int, int], capacity: int) -> tuple[list[tuple[dict[int, int], int]], int]:
    """Configurations as ``{length: copies}`` with whole numbers of sequences, which together hold exactly the histogram, and how
    many of the first are the program's."""
    lengths = np.array(sorted(histogram), np.int64)
    left = np.array([histogram[int(n)] for n in lengths], np.int64)
    plan: list[tuple[dict[int, int], int]] = []
    while left.any():
        live, before = np.flatnonzero(left), int((left * lengths).sum())
        solved = configuration_program(lengths[live], left[live].astype(float), capacity)
        by_fraction = sorted(solved, key=lambda key: solved[key] % 1, reverse=True)
        for key, times in [(key, int(solved[key] + 1e-9)) for key in solved] + [(key, 1) for key in by_fraction]:
            own = {int(live[k]): n for k, n in key}
            whole = min([times, *(int(left[k] // n) for k, n in own.items())])
            if whole:
                plan.append(({int(lengths[k]): n for k, n in own.items()}, whole))
                for k, n in own.items():
                    left[k] -= n * whole
        if before - int((left * lengths).sum()) < LEAST_PLACED * before:
            break
    programmed = len(plan)
    live = np.flatnonzero(left)
    for found, times in best_fit(lengths[live], left[live], capacity):
        plan.append(({int(lengths[live[k]]): n for k, n in found.items()}, times))
    return plan, programmed


def _slots(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """Per length: rows of (first rank, copies, first sequence, offset of the first copy), ascending by rank."""
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for found, times in plan:
        offset = 0
        for length, copies in sorted(found.items(), reverse=True):
            slots.setdefault(length, []).append((ranks.get(length, 0), copies, sequence, offset))
            ranks[length] = ranks.get(length, 0) + copies * times
            offset += copies * length
        sequence += times
    return {length: np.array(rows, np.int64) for length, rows in slots.items()}


def rank_by_length(parts: DataFrame) -> DataFrame:
    """Add ``rank``, from 0, among pieces of equal length. A length many pieces share is ranked within hash buckets, which are
    then put one after the other."""
    n = parts.count()
    buckets = max(LEAST_BUCKETS, -(-n // GROUP_ROWS))
    order = ["doc_id", "piece", "ids_crc32"]
    keyed = parts.withColumn("bucket", F.pmod(F.xxhash64(*order, "start"), F.lit(buckets)))
    sizes = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy(*order)
    ranked = keyed.withColumn("rank", F.row_number().over(inside) - 1)
    return ranked.join(offsets, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before")).drop("bucket", "before")


def pack(docs: DataFrame, path: str, end_id: int, capacity: int, *, spaces_kept: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for each piece of each document.

    A null or empty text is its end id alone, repeated rows are packed again, an empty table gives an empty one, columns
    other than the id and the text are not read. Texts are not shuffled; pieces, a few dozen bytes each, are written to
    a table once. The driver holds the histogram, at most ``capacity`` numbers, and a plan of about as many configurations.
    """
    parts = cut_lineage(cut_pieces(docs, path, end_id, capacity, spaces_kept=spaces_kept, id_col=id_col, text_col=text_col), "pieces")
    histogram = {int(r["length"]): int(r["n"]) for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = _slots(packing_plan(histogram, capacity)[0])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for own in np.unique(length):
                rows = np.flatnonzero(length == own)
                table = slots[int(own)]
                slot = table[np.searchsorted(table[:, 0], rank[rows], side="right") - 1]
                turn, copy = np.divmod(rank[rows] - slot[:, 0], slot[:, 1])
                sequence[rows] = slot[:, 2] + turn
                offset[rows] = slot[:, 3] + copy * own
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names)

    ranked = rank_by_length(parts).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank"))
    return ranked.mapInArrow(place, PIECE_SCHEMA + ", sequence_id long, offset long")
