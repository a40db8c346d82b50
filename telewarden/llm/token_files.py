"""Token ids of documents as files of patched frame-of-reference blocks.

A file is one shard of the documents in ascending order of doc_id, held in Parquet rows, so Spark's commit protocol makes
half-written or repeated tasks harmless and any store Spark knows will do. A row is a page of whole documents: their ids
and lengths, the blocks of their joined token ids, and where each block starts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telewarden.llm import pfor, pieces
from telewarden.llm.token_counts import byte_slices

#: A page is closed once it holds so many tokens.
PAGE_TOKENS = 131_072
#: Characters of a text that take part in the ranges.
RANGE_CHARS = 64
PAGE_SCHEMA = (
    "shard int, page int, shard_start long, tokens long, doc_ids array<long>, doc_tokens array<long>, blocks binary, block_starts binary"
)
_READ_SCHEMA = "doc_id long, shard int, page int, in_shard long, n_tokens long, ids_crc32 long"


def write_token_files(
    docs: DataFrame, location: str, path: str, end_id: int | None, *, spaces_kept: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode every text, append ``end_id`` to each, and write the files below ``location``.

    A null text is empty, so only the end id is written; a repeated row is written again, equal ids stand in order of their
    texts, null ids come first; an empty table gives files without rows; other columns are not read. Texts are shuffled once, by ranges
    of doc_id and of the beginning of the text, so one id may be many tasks; Spark balances them by sampling. A very long text is
    encoded in segments.
    """
    end = np.array([] if end_id is None else [end_id], np.uint32)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, page, before = TaskContext.get().partitionId(), 0, 0
        encoder = pieces.encoder(path, spaces_kept=spaces_kept, lengths_only=False)
        doc_ids, parts, held = [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal doc_ids, parts, held, page, before
            blocks, starts = pfor.encode(np.concatenate(parts))
            row = [shard, page, before, held, doc_ids, [len(p) for p in parts], blocks, starts]
            page, before = page + 1, before + held
            doc_ids, parts, held = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _PAGE_TYPE, strict=True)], schema=_PAGE_TYPE)

        for whole in batches:
            for batch in byte_slices(whole, "text"):
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder(batch.column("text").to_pylist()), strict=True):
                    doc_ids.append(doc_id)
                    parts.append(np.concatenate([np.frombuffer(ids, "<u4"), end]))
                    held += len(parts[-1])
                    if held >= PAGE_TOKENS:
                        yield close()
        if doc_ids:
            yield close()

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = chosen.repartitionByRange("doc_id", F.substring("text", 1, RANGE_CHARS)).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, PAGE_SCHEMA).write.option("compression", "uncompressed").parquet(location)


_PAGE_TYPE = pa.schema(
    [
        ("shard", pa.int32()), ("page", pa.int32()), ("shard_start", pa.int64()), ("tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
        ("doc_tokens", pa.list_(pa.int64())), ("blocks", pa.binary()), ("block_starts", pa.binary()),
    ]
)


def page_numbers(blocks: bytes, block_starts: bytes, tokens: int) -> np.ndarray:
    """Token ids of a page."""
    return pfor.decode(blocks, block_starts, tokens)


def read_digests(spark: SparkSession, location: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, decoded from the files.

    ``start`` counts the ids of all documents before it: those before it in its file, known from its page, and the
    totals of earlier files, of which there is one row each.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, page, before, tokens, doc_ids, doc_tokens, blocks, starts = (c[row].as_py() for c in batch.columns)
                ids = page_numbers(blocks, starts, tokens).astype("<u4", copy=False)
                bounds = np.concatenate([[0], np.cumsum(doc_tokens)])
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                n = len(doc_ids)
                columns = [doc_ids, [shard] * n, [page] * n, before + bounds[:-1], doc_tokens, crcs]
                types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "shard", "page", "in_shard", "n_tokens", "ids_crc32"]
                )

    pages = spark.read.schema(PAGE_SCHEMA).parquet(location)
    totals = pages.groupBy("shard").agg(F.sum("tokens").alias("tokens"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    offsets = totals.select("shard", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("offset"))
    read = pages.mapInArrow(decode, _READ_SCHEMA).join(F.broadcast(offsets), "shard")
    return read.select("doc_id", (F.col("offset") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32", "shard", "page")
