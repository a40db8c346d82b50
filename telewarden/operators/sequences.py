"""Sliding sequences and positional splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telewarden import schemas
from telewarden.functions.ordered import CHUNK_ROWS, chunk_window, epoch_micros, frame_chunks, own_rows
from telewarden.functions.quantiles import IN_MEMORY, nth_smallest
from telewarden.functions.skew import unit_hash


def create_sequences(
    df: DataFrame,
    features: Column,
    *,
    keys: Sequence[str],
    order: Sequence[str],
    length: int = schemas.SEQUENCE_LENGTH,
    into: str = "sequence",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add the last ``length`` feature values up to each row, stride 1; rows with fewer are left out.

    Arrays repeat every value ``length`` times, so reduce them in the same plan
    rather than storing them. ``order`` starts with the time column.
    """
    chunks = frame_chunks(df, keys, order, order[0], length, chunk_rows=chunk_rows)
    frame = chunk_window(keys).rowsBetween(-(length - 1), Window.currentRow)
    built = chunks.withColumn("_x", features).withColumn(into, F.collect_list("_x").over(frame)).drop("_x")
    return own_rows(built).where(F.col("pos") >= length - 1)


def flatten_sequence(sequence: Column) -> Column:
    """Row-major ``length * width`` vector."""
    return F.flatten(sequence)


def last_timestep(sequence: Column) -> Column:
    return F.element_at(sequence, -1)


def tile_sequence(features: Column, length: int = schemas.SEQUENCE_LENGTH) -> Column:
    """One vector repeated into a constant sequence."""
    return F.array_repeat(features, length)


def split_by_time(df: DataFrame, *, time_col: str, id_col: str, train_share: float = 0.8, into: str = "split", in_memory: int = IN_MEMORY) -> DataFrame:
    """Mark the earliest ``int(n * train_share)`` rows ``train`` and the rest ``val``; ids are numbers and break ties.

    The border row is an exact order statistic of the time, and of the id among rows of that very
    time, so nothing is sorted as a whole and marking is a filter on two numbers.
    """
    inside = earliest_share(df, time_col=time_col, id_col=id_col, share=train_share, in_memory=in_memory)
    return df.withColumn(into, F.when(inside, "train").otherwise("val"))


def earliest_share(df: DataFrame, *, time_col: str, id_col: str, share: float = 0.8, in_memory: int = IN_MEMORY) -> Column:
    """Whether a row is among the earliest ``int(n * share)`` of ``df``, as a comparison of its time and id with the border row's."""
    keys = df.select(epoch_micros(time_col).alias("us"), F.col(id_col).alias("id"))
    last = int(keys.count() * share) - 1
    if last < 0:
        return F.lit(False)
    us = nth_smallest(keys, "us", last, in_memory)
    before = keys.where(F.col("us") < us).count()
    border = nth_smallest(keys.where(F.col("us") == us), "id", last - before, in_memory)
    micros = epoch_micros(time_col)
    return (micros < us) | ((micros == us) & (F.col(id_col) <= border))


def split_by_hash(df: DataFrame, *, id_col: str, train_share: float = 0.8, seed: int = 42, into: str = "split") -> DataFrame:
    """A seeded split that needs no order at all."""
    return df.withColumn(into, F.when(unit_hash(F.col(id_col), F.lit(seed)) < train_share, "train").otherwise("val"))


def head_rows(df: DataFrame, order: Sequence[str], n: int = 100) -> DataFrame:
    return df.orderBy(*order).limit(n)
