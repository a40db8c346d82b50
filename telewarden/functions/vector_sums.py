"""Sums of array cells by key: by Spark's own aggregates where vectors are short, as matrices before and after the one shuffle where
they are long."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telewarden.functions.vectors import as_cells, as_matrix, is_complete

#: Numbers a task holds of keys that may come again, 32 MB; adding them up takes about four times that.
HELD_NUMBERS = 1 << 22
#: Numbers that go through Python at once, 1 MB.
BLOCK_NUMBERS = 1 << 17


def _codes(batch: pa.RecordBatch | pa.Table, keys: Sequence[str]) -> np.ndarray:
    """A number per row that agrees just where the keys do; null is a key like others."""
    codes = np.zeros(batch.num_rows, np.int64)
    for k in keys:
        column = batch.column(k)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        own = pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        # Renumbered after every column, so products stay below the square of the rows.
        codes = np.unique(codes * (int(own.max(initial=0)) + 1) + own, return_inverse=True)[1]
    return codes


def _slices(batches: Iterable[pa.RecordBatch | pa.Table], rows: int) -> Iterator[pa.Table]:
    """The batches in tables of a bounded number of rows, whose columns may all hold null, so that they can be put together."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield pa.Table.from_arrays(part.columns, names=part.schema.names)


def _add_up(parts: Sequence[pa.Table], keys: Sequence[str], width: int) -> pa.Table:
    """One row per key of ``keys, _n, _sum``."""
    part = pa.concat_tables(parts)
    codes = _codes(part, keys)
    order = np.argsort(codes, kind="stable")
    first = np.flatnonzero(np.diff(codes[order], prepend=-1))
    cells = np.concatenate([as_matrix(c, width) for c in part.column("_sum").chunks])
    sums = np.add.reduceat(cells[order], first, axis=0)
    n = np.add.reduceat(part.column("_n").to_numpy()[order], first)
    heads = part.select(list(keys)).take(pa.array(order[first]))
    return heads.append_column("_n", pa.array(n)).append_column("_sum", as_cells(sums))


def sum_by_key(df: DataFrame, keys: Sequence[str], vector: str, width: int, *, weight: str | None = None, combine: bool = True) -> DataFrame:
    """``keys, n, total``: sum of the weights and weighted sum of the complete vectors of each key; a key without any is left out.

    Tasks add up what they see, within a bound of memory, so a key that many rows share is shuffled about once per task. Then
    keys come together sorted and neighbours are added; a key's rows need not fit into memory. Without ``combine``, for rows without weight
    of which a task has one per key, the first step is left out, as it would only hold them once more.
    """
    if weight and not combine:
        raise ValueError("weighted rows have to be combined")
    keys = list(keys)
    weighed = df.where(is_complete(F.col(vector))).select(
        *keys, (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_n"), F.col(vector).cast("array<double>").alias("_sum")
    )
    schema = weighed.schema
    most = max(1, HELD_NUMBERS // max(width, 1))
    block = max(1, BLOCK_NUMBERS // max(width, 1))

    def sent(table: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from table.combine_chunks().to_batches(max_chunksize=block)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for part in _slices(batches, block):
            scaled = as_matrix(part.column("_sum").combine_chunks(), width) * part.column("_n").to_numpy()[:, None]
            held.append(part.drop_columns(["_sum"]).append_column("_sum", as_cells(scaled)))
            rows += part.num_rows
            if rows > most:
                held = [_add_up(held, keys, width)]
                rows = held[0].num_rows
                if 2 * rows > most:  # so that every row is added up a few times at most
                    yield from sent(held.pop())
                    rows = 0
        if held:
            yield from sent(_add_up(held, keys, width))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for part in _slices(batches, block):
            added = _add_up([part] if held is None else [held, part], keys, width)
            # The last key of the slice may go on in the next one.
            both = pa.concat_tables([added.select(keys), part.select(keys).slice(part.num_rows - 1)])
            codes = _codes(both, keys)
            open_ = codes[:-1] == codes[-1]
            held = added.filter(pa.array(open_))
            yield from sent(added.filter(pa.array(~open_)))
        if held is not None:
            yield from sent(held)

    met = (weighed.mapInArrow(partial, schema) if combine else weighed).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merge, schema)
    return met.select(*keys, F.col("_n").alias("n"), F.col("_sum").alias("total"))


def sum_columns_by_key(df: DataFrame, keys: Sequence[str], vector: str, width: int, *, weight: str | None = None) -> DataFrame:
    """What ``sum_by_key`` returns, by one aggregate per entry, for vectors of up to some hundred entries.

    No row leaves the JVM. Tasks add up before the shuffle and spill what exceeds their memory.
    """
    w = (F.col(weight) if weight else F.lit(1.0)).cast("double")
    entry = F.col(vector).cast("array<double>")
    sums = [F.sum(F.get(entry, F.lit(i)) * w if weight else F.get(entry, F.lit(i))).alias(f"_sum{i}") for i in range(width)]
    added = df.where(is_complete(F.col(vector))).groupBy(*keys).agg(F.sum(w).alias("n"), *sums)
    return added.select(*keys, "n", F.array(*[f"_sum{i}" for i in range(width)]).alias("total"))
