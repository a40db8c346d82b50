"""Placement of documents on shards by a permutation-filled lookup table.

Each shard prefers the slots of a table of prime size in an order of its own. Shards take turns claiming their next
preferred slot that is free until the table is full, so they share it evenly, and a lost or added shard moves
few slots. A document's slot is its hash modulo the size; the table is small and fixed, and joined by broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from math import isqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A prime, several hundred times the number of shards.
SLOTS = 65_537
SHARDS = 64


def lookup_table(shards: Sequence[str], slots: int = SLOTS, weights: Sequence[float] | None = None) -> np.ndarray:
    """The shard's place in ``shards`` for each slot. A shard of weight w claims w slots a turn, on average."""
    if len(set(shards)) != len(shards) or not shards or len(shards) > slots:
        raise ValueError("shards must be distinct names, at least one and at most one per slot")
    if any(slots % k == 0 for k in range(2, isqrt(slots) + 1)):
        raise ValueError("the number of slots must be a prime, or a shard's steps would not reach all of them")
    shares = np.ones(len(shards)) if weights is None else np.asarray(weights, float)
    if len(shares) != len(shards) or not (shares > 0).all():
        raise ValueError("each shard needs a positive weight")
    shares = shares / shares.max()
    digests = [hashlib.blake2b(name.encode(), digest_size=16).digest() for name in shards]
    at = [int.from_bytes(d[:8], "little") % slots for d in digests]
    skip = [int.from_bytes(d[8:], "little") % (slots - 1) + 1 if slots > 1 else 0 for d in digests]
    table, credit, free = np.full(slots, -1, np.int32), np.zeros(len(shards)), slots
    while free:
        for k in range(len(shards)):
            credit[k] += shares[k]
            if credit[k] < 1 - 1e-9:
                continue
            credit[k] -= 1
            while table[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % slots
            table[at[k]] = k
            free -= 1
            if not free:
                break
    return table


def place(docs: DataFrame, shards: Sequence[str], *, slots: int = SLOTS, weights: Sequence[float] | None = None) -> DataFrame:
    """``doc_id, slot, shard, row_bytes`` for each row of ``docs``; the names of other columns don't matter.

    Rows of one id share a shard, also repeated ones. Rows without an id are placed by their text, so that many of them don't meet in
    one shard; a null text has no bytes, an empty table gives an empty one. The broadcast table has ``slots`` rows.
    """
    spark = docs.sparkSession
    table = lookup_table(shards, slots, weights)
    lookup = spark.createDataFrame([(i, shards[k]) for i, k in enumerate(table.tolist())], "slot int, shard string")
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64(F.col("doc_id").cast("long")))
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.pmod(key, F.lit(slots)).cast("int").alias("slot"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("row_bytes")
    )
    return keyed.join(F.broadcast(lookup), "slot").select("doc_id", "slot", "shard", "row_bytes")
