"""Integer codes for strings, equal to the JVM's own string hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = 1 << 32
_HALF = 1 << 31


def _hash(text: Column, finish) -> Column:
    """Fold the characters once; ``finish`` maps the unsigned hash to the result."""

    def step(acc: Column, unit: Column) -> Column:
        return F.pmod(acc * F.lit(31) + unit, F.lit(_WORD))

    def fold(acc: Column, point: Column) -> Column:
        beyond = point - F.lit(0x10000)
        high, low = F.lit(0xD800) + F.shiftright(beyond, 10), F.lit(0xDC00) + F.pmod(beyond, F.lit(1024))
        return F.when(point < 0x10000, step(acc, point)).otherwise(step(step(acc, high), low))

    points = F.transform(F.split(text, ""), lambda ch: F.ascii(ch).cast("long"))
    return F.aggregate(points, F.lit(0).cast("long"), fold, finish)


def _signed(unsigned: Column) -> Column:
    return F.when(unsigned >= _HALF, unsigned - F.lit(_WORD)).otherwise(unsigned)


def string_hash(text: Column) -> Column:
    """Signed 32-bit polynomial hash (base 31) over UTF-16 units, as a bigint."""
    return _hash(text, _signed)


def hash_code(text: Column, buckets: int) -> Column:
    """``abs(hash) % buckets``; the one hash whose abs overflows keeps its sign, as in 32-bit arithmetic."""

    def code(unsigned: Column) -> Column:
        magnitude = F.when(unsigned == _HALF, unsigned - F.lit(_WORD)).otherwise(F.abs(_signed(unsigned)))
        return magnitude % F.lit(buckets)

    return _hash(text, code).cast("int")
