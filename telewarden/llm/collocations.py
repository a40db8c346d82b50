"""Phrase collocations by relational mining (SETM): occurrences are relations, and a longer phrase is a join of two that overlap.

The relation of a length holds where each frequent phrase of that length stands: row, piece, place and the phrase's number. It is
written bucketed by row and sorted by place, so that the merge join of neighbouring places moves no row. Joined pairs are grouped and
counted; only occurrences of frequent groups go into the next length's relation.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telewarden.functions.skew import is_small, lookup_join
from telewarden.llm.spelling import lower_ascii
from telewarden.llm.token_counts import byte_slices
from telewarden.session import cut_lineage, scratch_path
from telewarden.sources.readers import with_row_id

PIECE_ENDS, WORD = r"[.,;:!?\x0A-\x0D]", r"([^ \x09]+)"
LONGEST = 4
LEAST = 30
UNKNOWN = "und"
#: A bucket's texts, in bytes, and the most buckets.
BUCKET_BYTES, MOST_BUCKETS = 16 << 20, 50_000
#: A table of phrases is broadcast up to so many rows and bytes of words, else joined by a shuffle that spreads frequent ones.
LOOKUP_ROWS, LOOKUP_BYTES = 1_000_000, 64 << 20
#: Rows that are ranked together before each language's best meet, and the least number of such parts.
RANKED_ROWS, LEAST_PARTS = 200_000, 16
SCALE = 2_000_000
#: Buckets of the row alone do for a join on row, piece and place; a bucket that is one file is known to be sorted.
_BUCKET_SETTINGS = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}
# Byte by byte, as all these characters are single bytes that are part of no other: piece ends become line feeds, tabs blanks.
_MARKS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")
_NO_WORD, _END = -2, -3


@contextmanager
def _joined_in_buckets(spark: SparkSession) -> Iterator[None]:
    """Within, joins use the buckets and their order."""
    before = {name: spark.conf.get(name) for name in _BUCKET_SETTINGS}
    for name, value in _BUCKET_SETTINGS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def marked_text(text: str) -> bytes:
    """A text with A-Z in lower case, its pieces ended by line feeds and their words by blanks."""
    return text.encode().lower().translate(_MARKS)


def places_of(text: str, numbers: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece, place within it and number of each word that has one; ``numbers`` also has the marks of no word and of a piece's end."""
    tokens = marked_text(text).replace(b"\n", b" \n ").split(b" ")
    found = np.fromiter(map(numbers.get, tokens, repeat(-1)), np.int64, len(tokens))
    found = found[found != _NO_WORD]
    word = found != _END
    piece, id_ = np.cumsum(~word)[word], found[word]
    at = np.arange(len(id_))
    begins = np.diff(piece, prepend=-1) != 0
    at -= np.maximum.accumulate(np.where(begins, at, 0))
    kept = id_ >= 0
    return piece[kept], at[kept], id_[kept]


def count_words(texts: DataFrame) -> DataFrame:
    """``lang, word, n``; tasks add up the words of some megabytes of text at a time, so less is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "text"):
                held: dict[str, Counter[bytes]] = defaultdict(Counter)
                for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    held[lang].update(marked_text(text).split())  # at blanks and line feeds, as nothing else is left of white space
                for lang, own in held.items():
                    words = pa.array(list(own), pa.binary()).cast(pa.string())
                    columns = [pa.array([lang] * len(own), pa.string()), words, pa.array(own.values(), pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "n"])

    counted = texts.select("lang", "text").mapInArrow(count, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def numbered_occurrences(texts: DataFrame, names: DataFrame) -> DataFrame:
    """``row, piece, at, id`` of every word in ``names``, a table ``lang, word, id`` small enough to be everywhere."""
    numbers: dict[str, dict[bytes, int]] = defaultdict(lambda: {b"": _NO_WORD, b"\n": _END})
    for r in names.toLocalIterator():
        numbers[r["lang"]][r["word"].encode()] = r["id"]
    kind = {"int": pa.int32(), "bigint": pa.int64()}[dict(names.dtypes)["id"]]
    shared = texts.sparkSession.sparkContext.broadcast(dict(numbers))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for whole in batches:
            for batch in byte_slices(whole, "text", 1 << 20):
                rows, parts, places, ids = [], [], [], []
                for row, lang, text in zip(*(batch.column(c).to_pylist() for c in ("row", "lang", "text")), strict=True):
                    if lang in known:
                        piece, at, id_ = places_of(text, known[lang])
                        rows.append(np.full(len(id_), row, np.int64))
                        parts.append(piece)
                        places.append(at)
                        ids.append(id_)
                if not rows:
                    continue
                columns = [np.concatenate(c) for c in (rows, parts, places, ids)]
                types = [pa.int64(), pa.int32(), pa.int32(), kind]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["row", "piece", "at", "id"])

    return texts.mapInArrow(place, f"row long, piece int, at int, id {dict(names.dtypes)['id']}")


def occurrences(texts: DataFrame) -> DataFrame:
    """``row, lang, piece, at, word`` of every word of ``row, lang, text``, for tables of words too large to be everywhere."""
    pieces = texts.select("row", "lang", F.posexplode(F.split("text", PIECE_ENDS)).alias("piece", "words"))
    words = pieces.select("row", "lang", "piece", F.posexplode(F.regexp_extract_all("words", F.lit(WORD), F.lit(1))).alias("at", "word"))
    return words.withColumn("word", lower_ascii(F.col("word")))


def _numbered(phrases: DataFrame, label: str) -> DataFrame:
    """The stored table with a number ``id`` per row, as an int where that does."""
    stored = cut_lineage(phrases, label)
    kind = "int" if stored.count() < 1 << 31 else "long"
    return cut_lineage(with_row_id(stored, "id").withColumn("id", F.col("id").cast(kind)), label)


def _fits(table: DataFrame, size: int) -> bool:
    return size <= LOOKUP_BYTES and is_small(table, LOOKUP_ROWS)


class _Relations:
    """Bucketed relations of one run, dropped from the catalog at its end."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.names = spark, buckets, []

    def keep(self, found: DataFrame) -> DataFrame:
        name = f"occurrences_{uuid.uuid4().hex}"
        writer = found.write.bucketBy(self.buckets, "row").sortBy("row", "piece", "at")
        writer.option("path", scratch_path(self.spark, "occurrences")).saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def drop(self) -> None:
        for name in self.names:
            self.spark.sql(f"drop table if exists {name}")


def _longer(relation: DataFrame) -> DataFrame:
    """``row, piece, at, left, right``: the phrases at each place and at the next one of its piece."""
    here = relation.select("row", "piece", "at", F.col("id").alias("left"))
    following = relation.select("row", "piece", (F.col("at") - 1).alias("at"), F.col("id").alias("right"))
    return here.join(following.hint("merge"), ["row", "piece", "at"])


def _phrases(counted: DataFrame, parts: DataFrame) -> DataFrame:
    """Longer phrases from their two overlapping parts: ``heads`` and ``tails`` are counts of their first and last 1, 2, ... words."""
    first = parts.select(F.col("id").alias("left"), "lang", "phrase", "heads")
    last = parts.select(F.col("id").alias("right"), F.element_at(F.split("phrase", " "), -1).alias("last"), "tails")
    both = lookup_join(cut_lineage(lookup_join(counted, first, ["left"]), "counted"), last, ["right"])
    return both.select(
        "left", "right", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"),
        F.array_append("heads", F.col("n")).alias("heads"), F.array_append("tails", F.col("n")).alias("tails"),
    )


def mine(docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, dict[int, DataFrame]]:
    """``lang, n`` with the words of each language, and by length the frequent phrases: ``id, left, right, lang, phrase, heads, tails``."""
    spark = docs.sparkSession
    chosen = docs.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    words = cut_lineage(count_words(chosen), "words")
    totals = cut_lineage(words.groupBy("lang").agg(F.sum("n").alias("n")), "languages")
    one = words.where(F.col("n") >= least)
    known = {1: _numbered(one.select("lang", F.col("word").alias("phrase"), F.array("n").alias("heads"), F.array("n").alias("tails")), "phrases")}
    bytes_of_text = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    relations = _Relations(spark, max(1, min(MOST_BUCKETS, -(-bytes_of_text // BUCKET_BYTES))))
    names = known[1].select("lang", F.col("phrase").alias("word"), "id")
    try:
        if _fits(names, names.agg(F.sum(F.octet_length("word"))).first()[0] or 0):
            placed = numbered_occurrences(chosen.repartition(relations.buckets, "row"), names)
        else:
            placed = lookup_join(occurrences(chosen), names, ["lang", "word"], small_rows=0).repartition(relations.buckets, "row")
        relation = relations.keep(placed.select("row", "piece", "at", "id"))
        for length in range(2, longest + 1):
            with _joined_in_buckets(spark):
                groups = _longer(relation).groupBy("left", "right").agg(F.count(F.lit(1)).alias("n"))
                counted = cut_lineage(groups.where(F.col("n") >= least), "groups")
            known[length] = _numbered(_phrases(counted, known[length - 1]), "phrases")
            if length < longest:
                frequent = known[length].select("left", "right", "id")
                with _joined_in_buckets(spark):
                    if _fits(frequent, 0):
                        kept = _longer(relation).join(F.broadcast(frequent), ["left", "right"])
                    else:
                        kept = lookup_join(_longer(relation), frequent, ["left", "right"], small_rows=0).repartition(relations.buckets, "row")
                    relation = relations.keep(kept.select("row", "piece", "at", "id"))
    finally:
        relations.drop()
    return totals, known


def _scored(phrases: DataFrame, length: int) -> DataFrame:
    """``l, r, score`` of the lowest-scoring cut; products are decimals of 38 digits."""
    cuts = []
    for k in range(1, length):
        first, rest = f"element_at(heads, {k})", f"element_at(tails, {length - k})"
        score = f"cast(element_at(heads, -1) as decimal(20, 0)) * {SCALE} div cast({first} + {rest} as decimal(38, 0))"
        cuts.append(f"named_struct('score', {score}, 'k', {k}, 'l', {first}, 'r', {rest})")
    lowest = phrases.withColumn("cut", F.expr(f"array_min(array({', '.join(cuts)}))"))
    return lowest.select("id", "lang", "phrase", F.element_at("heads", -1).alias("a"), "cut.l", "cut.r", "cut.score")


def collocations(
    docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST, cover: tuple[int, int] = (80, 100), best: int = 2000, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``best`` phrases by score, count, and text.

    A phrase of 2 to ``longest`` words that stands ``least`` times within pieces is a candidate; its score is that of its
    lowest-scoring cut in two. It is dropped if a longer candidate holds it and stands at least ``cover`` as often. As a candidate
    between the two stands at least as often as the longer one, only those a word longer have to be looked at.

    A null text is empty, a null language is ``und``, repeated rows count again, an empty table gives an empty one, other columns are not
    read. A text of any length is cut into its words where it lies. The occurrences are written once per length below ``longest``, the
    phrases and their counts as small tables; a language's candidates are ranked in parts, of which at most ``best`` rows go on.
    """
    totals, known = mine(docs, least=least, longest=longest, lang_col=lang_col, text_col=text_col)
    found = None
    for length in range(2, longest + 1):
        scored = _scored(known[length], length)
        if length < longest:
            ends = known[length + 1].select(F.explode(F.array("left", "right")).alias("id"), F.element_at("heads", -1).alias("held"))
            longer = ends.groupBy("id").agg(F.max("held").alias("held"))
            covered = F.coalesce(F.col("held") * cover[1] >= F.col("a") * cover[0], F.lit(False))
            scored = scored.join(longer, "id", "left").where(~covered).drop("held")
        found = scored.drop("id") if found is None else found.unionByName(scored.drop("id"))
    stored = cut_lineage(found, "candidates")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    parts = max(LEAST_PARTS, -(-stored.count() // RANKED_ROWS))
    dealt = stored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    heads = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= best)
    ranked = heads.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    named = lookup_join(cut_lineage(ranked.drop("part"), "ranked"), totals, ["lang"])
    return named.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
