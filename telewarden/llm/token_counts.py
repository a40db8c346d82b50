"""Token counts of whole texts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telewarden.llm import pieces

SCHEMA = "doc_id long, n_bytes long, n_tokens long"
#: Texts of a batch that is encoded at once, in bytes.
BATCH_BYTES = 8 << 20


def byte_slices(batch: pa.RecordBatch, column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of about ``most`` bytes of text, however many rows that takes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin = held = 0
    for row, size in enumerate(sizes):
        if held and held + size > most:
            yield batch.slice(begin, row - begin)
            begin, held = row, 0
        held += int(size)
    if begin < batch.num_rows:
        yield batch.slice(begin)


def token_counts(docs: DataFrame, path: str, *, spaces_kept: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` for each row of ``docs``.

    Ids of added specials are left out; special strings inside a text are handled as the vocabulary file says. A null text
    is empty and has no tokens, a repeated row is counted again, an empty table gives an empty one, other columns are
    not read. There is no shuffle: scan splits are balanced by bytes, batches within a task are cut by bytes, and
    a text beyond a million characters is encoded in segments.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = pieces.encoder(path, spaces_kept=spaces_kept, lengths_only=True)
        for whole in batches:
            for batch in byte_slices(whole, "text"):
                text = batch.column("text")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").cast(pa.int64()),
                        pc.fill_null(pc.binary_length(text), 0).cast(pa.int64()),
                        pa.array(encode(text.to_pylist()), pa.int64()),
                    ],
                    ["doc_id", "n_bytes", "n_tokens"],
                )

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(count, SCHEMA)
