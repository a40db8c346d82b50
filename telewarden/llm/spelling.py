"""Spelling variants: words one edit apart, found by an index of variable-length grams.

A gram grows from two code points until at most a set number of places in all words hold it, or to the class's longest; only grams beyond
that number, the dictionary, have to be known to decompose a word, and their number is bounded. A word keeps the grams that no
other covers. For any single edit the grams it can touch are bounded per word, so a near word shares one of its rarest
``bound + 1`` grams, and all text on the gram's far side from the edit. Only those lists are written and merged; what meets there is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telewarden.session import cut_lineage

#: Letters of a word.
RUN = r"([A-Za-zÀ-ÿ]+)"
#: Mark a word's ends, so that its first and last letters have grams, too.
HEAD, TAIL = "\x02", "\x03"
LEAST_GRAM, LONGEST_GRAM = 2, 8
#: A gram is in the dictionary beyond one place in so many of all code points, which bounds the dictionary whatever the table's size.
PLACES_SHARE = 131_072
#: And beyond this many places.
LEAST_PLACES = 16
MAX_ROUNDS = 64

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all other letters as they are."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def letter_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, run``: every maximal run of letters of whole texts with its document's id as text; a null id is empty, a null text has no runs."""
    runs = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(1)))
    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), runs.alias("run"))
    return found.select("id", lower_ascii(F.col("run")).alias("run"))


def plant_deletions(runs: DataFrame, every: int) -> DataFrame:
    """``word``: each run, without one letter where ``every`` divides the CRC-32 of ``id:run``, which also chooses the letter."""
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    damaged = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.withColumn("h", h).select(F.when(F.col("h") % every == 0, damaged).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, *, least_letters: int = 5, least_count: int = 3) -> DataFrame:
    """``word, n`` of words with enough code points and occurrences; counts combine before the shuffle."""
    long_enough = words.where(F.length("word") >= least_letters)
    return long_enough.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _padded() -> Column:
    return F.concat(F.lit(HEAD), "word", F.lit(TAIL))


def frequent_grams(words: DataFrame, places: int) -> dict[str, int]:
    """Grams with more than ``places`` places in all words, with their number; shorter than the longest gram, as only these grow.

    Each of the few lengths has at most one in ``places`` of all code points, which bounds what the driver gets.
    """

    def grams_of(size: int) -> Column:
        begins = F.sequence(F.lit(1), F.greatest(F.length("w") - (size - 1), F.lit(1)))
        return F.transform(begins, lambda begin: F.substring("w", begin, F.lit(size)))

    marked = words.select(_padded().alias("w"))
    grams = marked.select(F.explode(F.flatten(F.array(*[grams_of(k) for k in range(LEAST_GRAM, LONGEST_GRAM)]))).alias("gram"))
    counted = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > places)
    return {r["gram"]: r["n"] for r in counted.collect()}


def decompose(marked: str, longest: int, frequent: dict[str, int]) -> list[tuple[int, int]]:
    """Begin and end of the grams that no other covers, by begin."""
    size, grams, reach = len(marked), [], 0
    for begin in range(size - 1):
        # What an earlier gram reaches but for its last letter is in the dictionary, so the walk goes on from there.
        end = max(begin + LEAST_GRAM, reach)
        while end < size and end - begin < longest and marked[begin:end] in frequent:
            end += 1
        if end > reach:
            grams.append((begin, end))
            reach = end
        if reach == size:
            break
    return grams


def affected_bound(marked: str, grams: list[tuple[int, int]], longest: int, frequent: dict[str, int]) -> int:
    """The most grams that one edit between the end marks can touch.

    Grams that end before the edit stay. Those across it go. One behind it may be covered by a new gram that begins before
    the edit, but only if the letters from the edit to its last but one are in the dictionary, as that new gram grew over them.
    """
    size, most = len(marked), 0
    for at in range(1, size):
        replaced = inserted = 0
        for begin, end in grams:
            if begin < at < end:
                inserted += 1
            elif begin >= at and end < at + longest and (end - 1 - at < LEAST_GRAM or marked[at : end - 1] in frequent):
                inserted += 1
            if begin <= at < end:
                replaced += 1
            elif begin > at and end <= at + longest and (end - 2 - at < LEAST_GRAM or marked[at + 1 : end - 1] in frequent):
                replaced += 1
        most = max(most, inserted, replaced if at < size - 1 else 0)
    return most


def keys_of(word: str, frequent: dict[str, int]) -> Iterator[tuple[int, str]]:
    """``(class, text)`` of the lists a word is in.

    A class compares words of its own two lengths with each other and with words a letter longer; its longest gram is half of its
    shortest marked word, so any edit leaves the first or the last gram alone. A list's text is its gram with everything before it, or
    everything behind it: an edit lies on one side only, and there is none on the other.
    """
    marked = HEAD + word + TAIL
    size = len(marked)
    own = min(size // 2, LONGEST_GRAM)
    for longest in {own, min((size - 1) // 2, LONGEST_GRAM)}:
        grams = decompose(marked, longest, frequent)
        rarest = sorted(grams, key=lambda g: (frequent.get(marked[g[0] : g[1]], 0), marked[g[0] : g[1]], g[0]))
        for begin, end in rarest[: affected_bound(marked, grams, longest, frequent) + 1]:
            if end < size:
                yield longest, "<" + marked[:end]
            if begin > 0:
                yield longest, ">" + marked[begin:]


def _postings(words: DataFrame, frequent: dict[str, int]) -> DataFrame:
    shared = words.sparkSession.sparkContext.broadcast(frequent)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = shared.value
        for batch in batches:
            rows = [(w, n, c, t) for w, n in zip(*(x.to_pylist() for x in batch.columns), strict=True) for c, t in keys_of(w, dictionary)]
            if rows:
                types = [pa.string(), pa.int64(), pa.int32(), pa.string()]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["word", "n", "class", "text"])

    lists = words.select("word", "n").mapInArrow(spread, "word string, n long, class int, text string")
    return lists.select(F.xxhash64("class", "text").alias("key"), "class", "word", "n", F.length("word").alias("size"))


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, na, b, nb``: each pair of words one edit apart, once. ``words`` is a stored table of distinct words of two code points or more, with counts."""
    total = words.agg(F.sum(F.length("word") + 2)).first()[0] or 0
    frequent = frequent_grams(words, max(LEAST_PLACES, total // PLACES_SHARE))
    lists = cut_lineage(_postings(words, frequent), "gram-lists")
    names = {"word": "a", "n": "na", "size": "sa"}
    left = lists.withColumnsRenamed(names)
    right = lists.select("key", F.col("class").alias("other"), F.col("word").alias("b"), F.col("n").alias("nb"), F.col("size").alias("sb"))
    longer = F.col("sb") == F.col("sa") + 1
    apart = longer | ((F.col("sb") == F.col("sa")) & (F.col("a") < F.col("b")))
    own = (F.col("class") == F.col("other")) & ((F.col("class") == LONGEST_GRAM) | (F.col("sa") < 2 * F.col("class")))
    met = left.join(right, "key").where(apart & own & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "na", "b", "nb").distinct()


def _roots(links: DataFrame) -> DataFrame:
    """``word, root`` for ``word, form`` links without cycles; every round doubles the steps taken."""
    reached = links.select("word", F.col("form").alias("root"))
    for _ in range(MAX_ROUNDS):
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        reached = cut_lineage(
            reached.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots"
        )
        if reached.where("moved").isEmpty():
            return reached.select("word", "root")
        reached = reached.select("word", "root")
    raise RuntimeError("links of spelling forms run in circles")


def group_variants(words: DataFrame, *, ratio: int = 2) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for a table of distinct words with their counts.

    Two words are near at exactly one insertion, deletion or replacement of a code point. The form is the near word of largest count,
    ties to the smallest in code-point order, if its count is at least ``ratio`` times (2 or more) the word's own; the root is where following
    forms ends, the word itself if it has none. Null words and those of fewer than two code points are left out, rows of one
    word are added up, an empty table gives an empty one, other columns are not read. Work goes by the lists' sizes; a list many words
    share is sorted, spilled and split by Spark's join like any key.
    """
    known = words.where(F.length("word") >= 2).groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    stored = cut_lineage(known, "words")
    pairs = near_pairs(stored)
    ends = F.explode(
        F.array(
            F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("m")),
            F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("m")),
        )
    )
    best = F.min(F.struct((-F.col("e.m")).alias("m"), F.col("e.near").alias("near")))
    near = pairs.select(ends.alias("e")).groupBy(F.col("e.word").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    is_form = -F.col("best.m") >= F.col("n") * ratio
    formed = stored.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.m")).alias("form_n"),
    )
    forms = cut_lineage(formed, "forms")
    roots = _roots(forms.where("form is not null"))
    return forms.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
