"""Mixing of sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Sources get whole blocks by highest quotients, and the blocks of a source are apportioned to its shards the same way; words
above a shard's most go to the source's other shards. A source's documents in a shard, in seeded order, form a stream that is
cut into blocks; seeded blocks are taken until the shard's quota is met, a full pass over the stream before any second one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telewarden.session import cut_lineage

#: Words of a block.
BLOCK_WORDS = 64
#: Documents a shard should have, and the most shards of a source; each source has its own shards.
SHARD_DOCS, MAX_SHARDS = 1_000, 4_096
#: A source's target is at most so many times its size, and so is what is taken of a document.
MOST_REPEATS = 3
#: Weights of the sources in code point order, repeating.
WEIGHTS = (1.0, 2.0, 3.0)
#: Multipliers of the block order; a multiplier must have no factor in common with the number of blocks.
_MULTIPLIERS = (1_000_003, 1_000_033, 1_000_037, 1_000_039)
#: Units of a copy in running sums, and the step of the offsets from stream to stream, the golden section of it.
_UNIT, _SPREAD = 1 << 30, 663_608_941
_WORD = r"[^\x20\x09-\x0D]+"


def source_table(sized: DataFrame, weights: Sequence[float]) -> DataFrame:
    """``source, source_size, source_docs, source_no, weight``: sources numbered from 0 in code point order, null last.

    Sources are cut into ranges, numbered inside each, and the ranges' counts are added up, so no task sees all of them.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    ranged = cut_lineage(totals.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    before = counts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    numbered = ranged.withColumn("no", F.row_number().over(inside) - 1).join(F.broadcast(before), "part")
    number = F.col("no") + F.col("before")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number % len(weights) + 1).cast("int"))
    return numbered.select("source", "source_size", "source_docs", number.alias("source_no"), weight.alias("weight"))


def with_targets(sources: DataFrame, most_repeats: int) -> DataFrame:
    """Add ``target``: shares of the total by weight, none above ``most_repeats`` sizes, what is cut off reshared by weight."""
    most = F.col("source_size") * F.lit(float(most_repeats))
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0)
    level, found = -1.0, 0.0
    while found > level:  # the level rises as sources reach their most, until no further one does
        level = found
        capped = F.col("weight") * level >= most if level else F.lit(False)
        free, spent = sources.agg(F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))), F.sum(F.when(capped, most).otherwise(0.0))).first()
        if not free or not total:
            break
        found = (total - spent) / free
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(max(level, found)), most))


def _seats(size: Column, seats: Column, total: Column, parties: Column) -> tuple[Column, Column]:
    """Seats that a party surely has, and those it may have at most, when ``seats`` go to ``parties`` of ``total`` size by highest quotients."""

    def at(houses: Column) -> Column:
        return F.when(houses > 0, F.coalesce(F.floor(F.try_divide(size * houses, total) + 0.5), F.lit(0))).otherwise(F.lit(0)).cast("long")

    return at(seats - parties / 2), at(seats + parties / 2 + 1)


def apportion_sources(sources: DataFrame, block_words: int) -> DataFrame:
    """Add ``blocks``: all blocks of the total go to the sources' targets by highest quotients ``target / (2 seats + 1)``."""
    total, parties = sources.agg(F.sum("target"), F.count(F.lit(1))).first()
    house = round((total or 0.0) / block_words)
    sure, most = _seats(F.col("target"), F.lit(float(house)), F.lit(float(total or 0)), F.lit(float(parties)))
    bounds = sources.withColumns({"sure": sure, "most": F.greatest(sure, most)})
    open_seats = house - int(bounds.agg(F.sum("sure")).first()[0] or 0)
    seats = bounds.where("most > sure").select("source_no", "target", F.explode(F.sequence(F.col("sure"), F.col("most") - 1)).alias("seat"))
    best = seats.orderBy((F.col("target") / (2 * F.col("seat") + 1)).desc(), "source_no").limit(max(0, open_seats))
    extra = best.groupBy("source_no").agg(F.count(F.lit(1)).alias("extra"))
    return bounds.join(extra, "source_no", "left").withColumn("blocks", F.col("sure") + F.coalesce("extra", F.lit(0))).drop("sure", "most", "extra")


def apportion_shards(shards: DataFrame) -> DataFrame:
    """``source_no, shard, blocks`` from ``source_no, shard, shard_size, source_size, source_blocks, source_shards``, the same way."""
    sure, most = _seats(F.col("shard_size"), F.col("source_blocks"), F.col("source_size"), F.col("source_shards"))
    bounds = shards.withColumns({"sure": sure, "most": F.greatest(sure, most)})
    given = Window.partitionBy("source_no")
    bounds = bounds.withColumn("open", F.col("source_blocks") - F.sum("sure").over(given))
    # One row per seat that is still open to a party, and one without a seat so that no shard is lost.
    seat = F.explode(F.concat(F.array(F.lit(-1).cast("long")), F.when(F.col("most") > F.col("sure"), F.sequence(F.col("sure"), F.col("most") - 1)).otherwise(F.array().cast("array<long>"))))
    seats = bounds.select("source_no", "shard", "sure", "open", "shard_size", seat.alias("seat"))
    quotient = F.when(F.col("seat") >= 0, F.col("shard_size") / (2 * F.col("seat") + 1)).otherwise(-1.0)
    place = F.row_number().over(given.orderBy(quotient.desc(), "shard", "seat"))
    won = ((F.col("seat") >= 0) & (F.col("place") <= F.col("open"))).cast("long")
    return seats.withColumn("place", place).groupBy("source_no", "shard").agg((F.first("sure") + F.sum(won)).alias("blocks"))


def shard_words(quotas: DataFrame, block_words: int, most_repeats: int) -> DataFrame:
    """Add ``words`` to ``source_no, shard, shard_size, source_size, source_blocks, blocks``: the words wanted of each shard.

    No shard gives more than ``most_repeats`` times its words. What is above goes to the source's other shards in proportion to
    what they can still give, so a source's words are those of its blocks unless the whole source has fewer.
    """
    quotas = quotas.withColumn("own", F.least(F.col("blocks") * block_words, F.col("shard_size") * most_repeats).cast("long"))
    quotas = quotas.withColumn("room", F.col("shard_size") * most_repeats - F.col("own"))
    source = Window.partitionBy("source_no")
    upto = source.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wanted = F.least(F.col("source_blocks") * block_words, F.col("source_size") * most_repeats).cast("long")
    quotas = quotas.withColumns({"over": wanted - F.sum("own").over(source), "all_room": F.sum("room").over(source), "room_upto": F.sum("room").over(upto)})

    def dealt(room: str) -> Column:  # exact: the product may exceed a long, and `over` is at most `all_room`
        share = F.expr(f"cast(over as decimal(19, 0)) * cast({room} as decimal(19, 0)) div cast(all_room as decimal(19, 0))")
        return F.when(F.col("over") > 0, share).otherwise(F.lit(0)).cast("long")

    words = F.col("own") + dealt("room_upto") - dealt("room_upto - room")
    return quotas.withColumn("words", words).drop("own", "room", "over", "all_room", "room_upto")


def _taken(block_words: int, seed: int) -> Column:
    """Words taken of a document at ``start`` of a stream of ``shard_size`` words of which ``words`` are wanted."""
    size, stream, wanted = F.col("size"), F.col("shard_size"), F.col("words")
    passes = F.coalesce(F.floor(F.try_divide(wanted, stream)), F.lit(0)).cast("long")  # a stream of empty texts has no words
    rest = wanted - passes * stream
    blocks = F.floor(stream / block_words).cast("long")
    full = F.floor(rest / block_words).cast("long")
    pick = F.pmod(F.xxhash64("source_no", "shard", F.lit(seed), F.lit("step")), F.lit(len(_MULTIPLIERS)))
    options = [F.when((blocks % m != 0) & (pick <= i), F.lit(m)) for i, m in enumerate(_MULTIPLIERS)]
    step = F.coalesce(*options, *[F.when(blocks % m != 0, F.lit(m)) for m in _MULTIPLIERS], F.lit(1)).cast("long")
    first = F.pmod(F.xxhash64("source_no", "shard", F.lit(seed)), F.greatest(blocks, F.lit(1)))
    settings = F.struct(rest.alias("rest"), blocks.alias("blocks"), full.alias("full"), step.alias("step"), first.alias("first"))

    def of_block(held: Column, block: Column) -> Column:
        own = F.col("plan")
        order = F.when(block >= own["blocks"], own["blocks"]).otherwise(F.pmod(block * own["step"] + own["first"], F.greatest(own["blocks"], F.lit(1))))
        words = F.when(order < own["full"], F.lit(block_words)).when(order == own["full"], own["rest"] - own["full"] * block_words).otherwise(0)
        begin = block * block_words
        overlap = F.least(F.col("start") + F.col("size"), begin + words) - F.greatest(F.col("start"), begin)
        return held + F.greatest(overlap, F.lit(0)).cast("long")

    part = F.aggregate(
        F.sequence(F.floor(F.col("start") / block_words).cast("long"), F.floor((F.col("start") + size - 1) / block_words).cast("long")), F.lit(0).cast("long"), of_block
    )
    return settings, F.when(size == 0, F.lit(0).cast("long")).otherwise(passes * size + part)


def mix(
    docs: DataFrame,
    *,
    seed: int = 7,
    weights: Sequence[float] = WEIGHTS,
    most_repeats: int = MOST_REPEATS,
    block_words: int = BLOCK_WORDS,
    row: Column | None = None,
) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for each row of ``docs``, with ``row``, and ``source_no, shard, tie`` of its
    stream, beside them if given.

    Sizes are words of the whole text; a null text has none and nothing of it is taken. A null source is a source of its
    own, the last one. Equal documents of one id lie side by side in a stream and are taken like others. An empty
    table gives an empty one; columns that are not needed are not read. A source's taken words are those of
    its blocks, so they differ from its target by half a block or so, whatever the number of its shards and the size of the
    table. Which blocks are taken depends on the ids, the texts and the seed only.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long")
    kept = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("text").alias("tie")]
    sized = cut_lineage(docs.select(*kept), "sizes")
    sources = cut_lineage(apportion_sources(with_targets(source_table(sized, weights), most_repeats), block_words), "quotas")
    shard_count = F.least(F.lit(MAX_SHARDS), F.ceil(F.col("source_docs") / SHARD_DOCS)).cast("long")
    facts = sources.select(F.col("source").alias("own"), "source_no", "source_size", "target", F.col("blocks").alias("source_blocks"), shard_count.alias("shard_count"))
    same = F.col("source").eqNullSafe(F.col("own"))
    shard = F.pmod(F.xxhash64("doc_id", "tie", F.lit(seed), F.lit("shard")), F.col("shard_count")).alias("shard")
    groups = sized.join(facts.select("own", "source_no", "shard_count"), same).groupBy("source_no", shard).agg(F.sum("size").alias("shard_size"))
    held = groups.join(facts.select("source_no", "source_size", "source_blocks"), "source_no")
    held = held.withColumn("source_shards", F.count(F.lit(1)).over(Window.partitionBy("source_no")))
    quotas = held.join(apportion_shards(held), ["source_no", "shard"])
    wanted = shard_words(quotas, block_words, most_repeats).select(
        F.col("source_no").alias("q_source"), F.col("shard").alias("q_shard"), "shard_size", "words"
    )
    wanted = cut_lineage(wanted, "shard-quotas")
    rows = sized if row is None else docs.select(*kept, row.alias("row"))
    placed = rows.join(facts.drop("source_blocks"), same).withColumn("shard", shard).drop("own", "source", "shard_count")
    stream = Window.partitionBy("source_no", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "tie")
    start = F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    joined = placed.withColumn("start", start).join(wanted, (F.col("source_no") == F.col("q_source")) & (F.col("shard") == F.col("q_shard")))
    plan, taken = _taken(block_words, seed)
    out = ["doc_id", "size", "source_size", "target", "taken"]
    return joined.withColumn("plan", plan).withColumn("taken", taken).select(*out, *([] if row is None else ["row", "source_no", "shard", "tie"]))


def whole_copies(mixed: DataFrame, seed: int) -> DataFrame:
    """Add ``copies`` to what ``mix`` gives beside a ``row``: ``taken / size`` of each document, rounded up or down along its stream.

    From the longest document down, copies are the whole numbers that the running sum of shares passes, so a stream's words differ
    from what is taken of it by less than its longest document, and by half of it at most in a source of one stream. The sums start
    at evenly spread offsets in a source's streams, so that these differences cancel. Sums are exact, in units of 2^-30.
    """
    stream = Window.partitionBy("source_no", "shard").orderBy(F.col("size").desc(), F.xxhash64("doc_id", F.lit(seed), F.lit("copies")), "doc_id", "tie")
    share = F.when(F.col("size") > 0, F.expr(f"taken * {_UNIT}L div size")).otherwise(F.lit(0))
    offset = F.pmod(F.lit(_UNIT // 2) + F.col("shard") * _SPREAD, F.lit(_UNIT))
    upto = mixed.withColumn("share", share).withColumn("upto", F.sum("share").over(stream.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    copies = F.shiftright(F.col("upto") + offset, 30) - F.shiftright(F.col("upto") - F.col("share") + offset, 30)
    return upto.withColumn("copies", copies.cast("int")).drop("share", "upto")
