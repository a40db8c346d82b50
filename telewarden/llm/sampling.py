"""Bounded samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = 1 << 30


def drawn(id_col: str, share: Column, seed: int) -> Column:
    """Whether a row is in a sample of ``share`` of all rows, by its id's hash."""
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(_UNITS)) < share * _UNITS


def fold(id_col: str, folds: int) -> Column:
    """CRC-32 of the id as text, modulo ``folds``; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)), F.lit(-1)).cast("int")
