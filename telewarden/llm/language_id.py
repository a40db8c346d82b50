"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter has a mask of languages in each slot, so a look-up of an n-gram takes the masks of its slots, ands them, and
has all languages that contain it. Per-language counts over a text, corrected for the filter's false positives, decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from telewarden.llm.sampling import drawn
from telewarden.llm.token_counts import byte_slices

#: Documents sampled per language for fitting, in expectation.
SAMPLE_DOCS = 4_000
#: An n-gram is put into a language's set if it is there at least so often in the sample, and at least at this share of its
#: relative frequency in the language where it is most frequent.
LEAST_COUNT, LEAST_SHARE = 3, 0.25
#: Least slots of the filter, slots for each n-gram of the language with most of them, and look-ups per n-gram.
SLOTS, SLOTS_PER_GRAM, LOOKUPS = 1 << 20, 16, 2
UNKNOWN = "und"
_TEXTS_BYTES = 2 << 20
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of lower-case letters around each letter, other characters counting as a blank, and how many each text has."""
    lowered = [t.lower() for t in texts]
    sizes = np.array([len(t) for t in lowered], np.int64)
    codes = np.frombuffer(" ".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint64)
    letter = _letters()[codes.astype(np.int64)]
    codes[~letter] = 32
    centre = np.flatnonzero(letter)
    grams = codes[centre - 1] | codes[centre] << np.uint64(21) | codes[centre + 1] << np.uint64(42)
    ends = np.cumsum(sizes + 1)  # text k takes places ends[k - 1] + 1 to ends[k] - 1 of the padded codes
    counts = np.diff(np.searchsorted(centre, np.concatenate([[0], ends])))
    return grams, counts


def _slots(grams: np.ndarray, slots: int) -> list[np.ndarray]:
    shift = np.uint64(64 - (slots.bit_length() - 1))
    return [((grams * m ^ (grams * m >> np.uint64(29))) * _MIX[1 - k]) >> shift for k, m in enumerate(_MIX[:LOOKUPS])]


@dataclass
class LanguageFilter:
    """``masks``: slots by words of 64 languages; ``false_rate``: chance that a foreign n-gram is found, per language."""

    languages: list[str]
    masks: np.ndarray
    false_rate: np.ndarray

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Trigrams of each text, and how many of them each language contains, less the expected false ones."""
        grams, sizes = trigrams(texts)
        found = self.masks[_slots(grams, len(self.masks))[0]]
        for at in _slots(grams, len(self.masks))[1:]:
            found &= self.masks[at]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        held = np.empty((len(texts), len(self.languages)))
        for k in range(len(self.languages)):
            bit = found[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)
            total = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
            held[:, k] = total[bounds[1:]] - total[bounds[:-1]]
        return sizes, np.maximum(0, held - sizes[:, None] * self.false_rate) / (1 - self.false_rate)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        sizes, held = self.counts(texts)
        best = held.argmax(axis=1)
        score = np.minimum(1.0, held[np.arange(len(texts)), best] / np.maximum(sizes, 1))
        return [self.languages[b] if n else UNKNOWN for b, n in zip(best, sizes, strict=True)], np.where(sizes > 0, score, 0.0)


def build_filter(languages: list[str], grams: np.ndarray, owner: np.ndarray, slots: int | None = None) -> LanguageFilter:
    """``languages`` by falling frequency, so that ties go to the commoner one; ``owner[i]`` is the language of ``grams[i]``.

    ``slots`` is a power of two; by default it grows with the n-grams, whose number the sample bounds.
    """
    if slots is None:
        most = int(np.bincount(owner, minlength=1).max(initial=0))
        slots = max(SLOTS, 1 << (SLOTS_PER_GRAM * most - 1).bit_length()) if most else SLOTS
    masks = np.zeros((slots, max(1, -(-len(languages) // 64))), np.uint64)
    rates = np.zeros(len(languages))
    for k in range(len(languages)):
        bit = np.uint64(1) << np.uint64(k % 64)
        for at in _slots(grams[owner == k], slots):
            masks[at, k // 64] |= bit
        rates[k] = (masks[:, k // 64] & bit != 0).mean() ** LOOKUPS
    return LanguageFilter(languages, masks, np.minimum(rates, 0.99))


def fit(docs: DataFrame, learn: Column, *, sample_docs: int = SAMPLE_DOCS, seed: int = 11) -> LanguageFilter:
    """Fit on text and lang of rows where ``learn`` holds: a sample of about ``sample_docs`` per language, by hash of the id.

    The driver gets the sample's n-grams that pass the least count, so a number bounded by the sample.
    """
    usable = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = usable.groupBy(F.col("lang").alias("own")).agg(F.count(F.lit(1)).alias("n"))
    shares = counts.select("own", F.least(F.lit(1.0), F.lit(float(sample_docs)) / F.col("n")).alias("share"), "n")
    languages = [(r["own"], r["n"]) for r in counts.collect()]
    languages = [lang for lang, _ in sorted(languages, key=lambda r: (-r[1], r[0]))]
    if not languages:
        return build_filter([], np.zeros(0, np.uint64), np.zeros(0, np.int64))
    sample = usable.join(F.broadcast(shares), F.col("lang") == F.col("own")).where(drawn("doc_id", F.col("share"), seed)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "text", _TEXTS_BYTES):
                lang = np.array(batch.column("lang").to_pylist(), object)
                for own in set(lang.tolist()):
                    texts = batch.column("text").filter(pa.array(lang == own)).to_pylist()
                    grams, n = np.unique(trigrams(texts)[0].astype(np.int64), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([own] * len(n)), pa.array(grams), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    sums = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = sums.where(F.col("n") >= LEAST_COUNT).toArrow()
    order = {lang: k for k, lang in enumerate(languages)}
    owner = np.array([order[x] for x in found.column("lang").to_pylist()], np.int64)
    grams, n = found.column("gram").to_numpy(), found.column("n").to_numpy().astype(float)
    rate = n / np.maximum(1, np.bincount(owner, n, len(languages)))[owner]
    values, at = np.unique(grams, return_inverse=True)
    most = np.zeros(len(values))
    np.maximum.at(most, at, rate)
    keep = rate >= LEAST_SHARE * most[at]
    return build_filter(languages, grams[keep].astype(np.uint64), owner[keep])


def identify(docs: DataFrame, model: LanguageFilter, *, keep: Column | None = None) -> DataFrame:
    """``doc_id, lang_pred, score`` for each row of ``docs``, with ``keep`` beside them as ``row`` if given.

    Whole texts count. ``und`` with score 0 stands for a null text, one without letters, and any text if nothing could be learned. The
    score is the share of the text's n-grams that the language contains. Ties go to the commoner language, then to the smaller
    name. Repeated rows get equal results, an empty table an empty one; columns other than the id and the text are not read. The
    filter is broadcast; its size goes by the n-grams of the sample.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), *([] if keep is None else [keep.alias("row")])]
    chosen = docs.select(*columns)
    with_row = keep is not None

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "text", _TEXTS_BYTES):
                names, score = shared.value.predict(pc.fill_null(batch.column("text"), "").to_pylist())
                rows = [batch.column("row")] if with_row else []
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score), *rows], ["doc_id", "lang_pred", "score", *(["row"] if rows else [])]
                )

    schema = StructType.fromDDL("doc_id long, lang_pred string, score double")
    if with_row:
        schema.add(chosen.schema["row"])
    return chosen.mapInArrow(predict, schema)
