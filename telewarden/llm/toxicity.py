"""Toxicity of texts by a learned lexicon, matched with misspellings, and the context of each match.

The lexicon, whole terms and stems, is learned from labelled texts and held as a trie. Levenshtein automata of all entries, intersected with
the trie, form one automaton that reads a word once and knows the entry it is or misspells. A match scores what
its context window holds: other matches around it count for abuse, a window in quotation marks counts apart as quotation.
A logistic model over these scores gives the probability of the label.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from telewarden.llm.sampling import drawn
from telewarden.llm.token_counts import byte_slices
from telewarden.session import cut_lineage

#: Labelled documents sampled per class for fitting, in expectation; so what reaches the driver is bounded.
SAMPLE_DOCS = 6_000
#: Entries must be in so many sampled toxic texts, this many times likelier to be toxic than any text, and so significant that about
#: this many entries in all would be there by chance.
LEAST_DOCS, LEAST_LIFT, CHANCE_ENTRIES = 3, 3.0, 0.5
#: Lengths of stems; a longer beginning that has this share of a stem's texts is preferred.
STEM_LENGTHS, SAME_SHARE = range(4, 11), 0.9
#: Edits that are forgiven, in entries of at least so many letters: whole terms, stems.
EDITS, LEAST_TERM, LEAST_STEM = 1, 5, 7
#: Words on either side of a match that belong to its window.
WINDOW = 8
#: Bytes of the words that a worker remembers, of an entry besides its characters, and automaton states.
REMEMBERED, ENTRY_BYTES, STATES = 96 << 20, 150, 50_000
_OPENING, _CLOSING, _BOTH = "“„«‹‘(", "”»›’)", "\"'"
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_TEXTS_BYTES = 2 << 20


def words_of(text: str) -> list[str]:
    return text.split()


def bare(word: str) -> str:
    """A word in lower case without punctuation around it."""
    word = word.lower()
    return word if word.isalpha() else _EDGE.sub("", word)


class LexiconAutomaton:
    """Deterministic automaton over sets of (trie node, edits), built as words need it.

    Entries are ``(text, is_stem)``; a stem matches all words that begin with it. ``match`` gives (entry, edits) of the entry with fewest
    edits, the first of equals, or None.
    """

    def __init__(self, entries: list[tuple[str, bool]]):
        self.entries = entries
        self._children: list[dict[str, int]] = [{}]
        self._ends: list[list[int]] = [[]]
        for k, (text, _) in enumerate(entries):
            node = 0
            for letter in text:
                if letter not in self._children[node]:
                    self._children[node][letter] = len(self._children)
                    self._children.append({})
                    self._ends.append([])
                node = self._children[node][letter]
            self._ends[node].append(k)
        self._letters = set("".join(t for t, _ in entries))
        self._reset()

    def _reset(self) -> None:
        self._states: dict[frozenset, int] = {}
        self._moves: list[dict[str, int]] = []
        self._sets: list[frozenset] = []
        self._accepts: list[tuple[tuple[int, int] | None, tuple[int, int] | None]] = []
        self._start = self._state({(0, 0)})

    def _state(self, nodes: set[tuple[int, int]]) -> int:
        """The state of a set, closed under skipped letters of entries."""
        work = list(nodes)
        while work:
            node, edits = work.pop()
            if edits < EDITS:
                for child in self._children[node].values():
                    if (child, edits + 1) not in nodes:
                        nodes.add((child, edits + 1))
                        work.append((child, edits + 1))
        key = frozenset(nodes)
        if key not in self._states:
            self._states[key] = len(self._sets)
            self._sets.append(key)
            self._moves.append({})
            found: list[tuple[int, int] | None] = [None, None]
            for node, edits in key:
                for k in self._ends[node]:
                    text, stem = self.entries[k]
                    if edits == 0 or len(text) >= (LEAST_STEM if stem else LEAST_TERM):
                        if found[stem] is None or (edits, k) < found[stem]:
                            found[stem] = (edits, k)
            self._accepts.append((found[0], found[1]))
        return self._states[key]

    def _step(self, state: int, letter: str) -> int:
        nodes: set[tuple[int, int]] = set()
        for node, edits in self._sets[state]:
            child = self._children[node].get(letter)
            if child is not None:
                nodes.add((child, edits))
            if edits < EDITS:
                nodes.add((node, edits + 1))  # a letter too many
                nodes.update((c, edits + 1) for c in self._children[node].values())  # another letter
        return self._state(nodes)

    def match(self, word: str) -> tuple[int, int] | None:
        if len(self._sets) > STATES:
            self._reset()
        state, best = self._start, None
        for letter in word:
            if letter not in self._letters:
                letter = ""
            moves = self._moves[state]
            if letter not in moves:
                moves[letter] = self._step(state, letter)
            state = moves[letter]
            stem = self._accepts[state][1]
            if stem is not None and (best is None or stem < best):
                best = stem
            if not self._sets[state]:
                break
        else:
            term = self._accepts[state][0]
            if term is not None and (best is None or term < best):
                best = term
        return None if best is None else (best[1], best[0])


def _quoted(words: list[str], at: int) -> bool:
    """Whether a word lies within quotation marks that open and close inside its window."""
    opened = False
    for k in range(at, max(-1, at - WINDOW - 1), -1):
        word = words[k]
        if k < at and word[-1] in _CLOSING + _BOTH:
            break
        if word[0] in _OPENING + _BOTH:
            opened = True
            break
    if not opened:
        return False
    for k in range(at, min(len(words), at + WINDOW + 1)):
        if k > at and words[k][0] in _OPENING + _BOTH:
            return False
        if words[k].rstrip(".,;:!?")[-1:] in tuple(_CLOSING + _BOTH):
            return True
    return False


#: Features of a text: whether and how much unquoted matches score, exact ones and misspellings, the densest window, and quoted ones.
FEATURES = ("any", "exact", "misspelt", "densest", "share", "quoted")


@dataclass
class ToxicityModel:
    entries: list[tuple[str, bool]]
    weights: np.ndarray  # of the entries
    coefficients: np.ndarray  # of the features, the constant last

    def __post_init__(self):
        self._automaton, self._seen, self._held = None, {}, 0

    def __getstate__(self):
        return {"entries": self.entries, "weights": self.weights, "coefficients": self.coefficients, "_automaton": None, "_seen": {}, "_held": 0}

    def features(self, texts: list[str]) -> np.ndarray:
        """Rows of ``FEATURES``. Words are looked up once and remembered."""
        if self._automaton is None:
            self._automaton = LexiconAutomaton(self.entries)
        out = np.zeros((len(texts), len(FEATURES)))
        for row, text in enumerate(texts):
            if self._held > REMEMBERED:
                self._seen.clear()
                self._held = 0
            words = words_of(text)
            try:
                found = list(map(self._seen.__getitem__, words))
            except KeyError:
                match = self._automaton.match
                for word in set(words).difference(self._seen):
                    plain = bare(word)
                    self._seen[word] = match(plain) if plain else None
                    self._held += ENTRY_BYTES + 2 * len(word)
                found = list(map(self._seen.__getitem__, words))
            if any(found):
                out[row] = self._score(words, found)
        return out

    def _score(self, words: list[str], found: list[tuple[int, int] | None]) -> np.ndarray:
        at = np.array([k for k, hit in enumerate(found) if hit is not None])
        weight = np.array([self.weights[found[k][0]] for k in at])
        edits = np.array([found[k][1] for k in at])
        quoted = np.array([_quoted(words, k) for k in at])
        own = np.where(quoted, 0.0, np.where(edits > 0, weight / 2, weight))
        total = np.concatenate([[0.0], np.cumsum(own)])
        windows = total[np.searchsorted(at, at + WINDOW, side="right")] - total[np.searchsorted(at, at - WINDOW)]
        return np.array(
            [
                float((~quoted).any()), np.log1p(own[edits == 0].sum()), np.log1p(own[edits > 0].sum()), np.log1p(windows.max()),
                np.log1p(100 * own.sum() / len(words)), np.log1p(weight[quoted].sum()),
            ]
        )

    def score(self, texts: list[str]) -> np.ndarray:
        features = np.column_stack([self.features(texts), np.ones(len(texts))])
        return 1 / (1 + np.exp(-np.clip(features @ self.coefficients, -40, 40)))


def _beginnings(text: str) -> tuple[set[str], set[str]]:
    """Distinct words of a text, and the stems they begin with."""
    words = {w for w in (bare(x) for x in set(words_of(text))) if len(w) >= 3 and w.isalpha()}
    return words, {w[:n] for w in words for n in STEM_LENGTHS if len(w) > n}


def _count(sample: DataFrame, wanted: frozenset[str] | None) -> DataFrame:
    """Texts that hold each term (``=``) or stem (``^``); all of them, or those of a bounded list."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                words, stems = _beginnings(text or "")
                keys = {"=" + w for w in words} | {"^" + s for s in stems}
                totals.update(keys if wanted is None else keys & wanted)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], ["entry", "n"])

    return sample.select("text").mapInArrow(count, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))


def _fetched(counts: DataFrame) -> dict[str, int]:
    """Counts of a sample's entries, by Arrow, which takes a fraction of the memory of rows."""
    table = counts.toArrow()
    return dict(zip(table.column("entry").to_pylist(), table.column("n").to_pylist(), strict=True))


def choose_entries(inside: dict[str, int], outside: dict[str, int], toxic: int, clean: int) -> tuple[list[tuple[str, bool]], np.ndarray]:
    """Entries with their log odds, by texts that hold them, from counts by ``=term`` and ``^stem``."""

    base = toxic / (toxic + clean)

    def odds(key: str) -> float:
        return math.log((inside[key] + 0.5) / (toxic + 1)) - math.log((outside.get(key, 0) + 0.5) / (clean + 1))

    def by_chance(a: int, b: int) -> float:
        """Chance that at least ``a`` of ``a + b`` texts are toxic."""
        n = a + b
        logs = (math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(base) + (n - k) * math.log1p(-base) for k in range(a, n + 1))
        return sum(map(math.exp, logs))

    tested = [k for k in inside if inside[k] >= LEAST_DOCS]
    likely = [k for k in tested if inside[k] > min(LEAST_LIFT * base, (1 + base) / 2) * (inside[k] + outside.get(k, 0))]
    good = {k: odds(k) for k in likely if by_chance(inside[k], outside.get(k, 0)) * len(tested) < CHANCE_ENTRIES}
    longer: dict[str, list[str]] = {}
    for key in good:
        shorter = key[1:-1] if key[0] == "^" else None
        for stem in [shorter] if shorter else [key[1:n] for n in range(STEM_LENGTHS[0] + 1, len(key))]:
            longer.setdefault("^" + stem, []).append(key)
    chosen: dict[str, float] = {}
    for key in sorted(good, key=lambda k: (len(k), k)):
        text = key[1:]
        if any("^" + text[:n] in chosen for n in range(STEM_LENGTHS[0], len(text))):
            continue  # a chosen stem matches it
        if key[0] == "^" and any(inside[k] >= SAME_SHARE * inside[key] for k in longer.get(key, [])):
            continue
        chosen[key] = good[key]
    entries = sorted(chosen)
    return [(k[1:], k[0] == "^") for k in entries], np.array([chosen[k] for k in entries])


def fit_logistic(features: np.ndarray, labels: np.ndarray, importance: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Newton steps of a ridge logistic regression; the last column of ``features`` is the constant and isn't shrunk."""
    shrink = np.full(features.shape[1], ridge)
    shrink[-1] = 1e-6
    w = np.zeros(features.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -40, 40)))
        gradient = features.T @ (importance * (p - labels)) + shrink * w
        curve = (features * (importance * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ features + np.diag(shrink)
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, learn: Column, *, sample_docs: int = SAMPLE_DOCS, seed: int = 13) -> ToxicityModel:
    """Fit on the texts of labelled rows where ``learn``, of doc_id, holds; text and label are all that is used.

    A document with several labels is toxic if one is. About ``sample_docs`` of each class are drawn by hash of the id; their ids are
    broadcast, and each text counts once. Classes count with the weight they have among all labelled rows.
    """
    marked = labels.where(learn & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {int(r["toxic"]): r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        rate = (toxic + 0.5) / (toxic + clean + 1)
        return ToxicityModel([], np.zeros(0), np.array([0.0] * len(FEATURES) + [np.log(rate / (1 - rate))]))
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, sample_docs / toxic))).otherwise(F.lit(min(1.0, sample_docs / clean)))
    ids = marked.where(F.col("toxic").isin(0, 1) & drawn("doc_id", share, seed))
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id")
    texts = cut_lineage(texts.select("text", "toxic").distinct(), "labelled")  # copies of a text say nothing new
    drawn_sizes = {1: 0, 0: 0} | {int(r["toxic"]): r["n"] for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    inside = _fetched(_count(texts.where("toxic = 1"), None).where(F.col("n") >= LEAST_DOCS))
    outside = _fetched(_count(texts.where("toxic = 0"), frozenset(inside)))
    entries, weights = choose_entries(inside, outside, drawn_sizes[1], drawn_sizes[0]) if min(drawn_sizes.values()) else ([], np.zeros(0))
    model = ToxicityModel(entries, weights, np.zeros(len(FEATURES) + 1))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "text", _TEXTS_BYTES):
                found = shared.value.features(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), *[pa.array(c) for c in found.T]], ["toxic", *FEATURES])

    schema = "toxic int, " + ", ".join(f"{f} double" for f in FEATURES)
    rows = texts.select("toxic", "text").mapInArrow(describe, schema).groupBy("toxic", *FEATURES).agg(F.count(F.lit(1)).alias("n")).toArrow()
    label = rows.column("toxic").to_numpy().astype(float)
    features = np.column_stack([*[rows.column(f).to_numpy() for f in FEATURES], np.ones(len(label))])
    importance = rows.column("n").to_numpy() * np.where(label == 1, toxic / max(1, drawn_sizes[1]), clean / max(1, drawn_sizes[0]))
    # Misspellings and quotations may be missing among the labels; what then stays at 0 is known only as far as the model goes.
    model.coefficients = fit_logistic(features, label, importance)
    return model


def score(docs: DataFrame, model: ToxicityModel, *, keep: Column | None = None) -> DataFrame:
    """``doc_id, score, predicted`` for each row of ``docs``, with ``keep`` beside them as ``row`` if given.

    Whole texts count. A null or empty text scores like any text without matches. Repeated rows get equal results, an empty table gives an
    empty one; columns other than the id and the text are not read. The model is broadcast, its size bounded by the sample.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), *([] if keep is None else [keep.alias("row")])]
    chosen = docs.select(*columns)
    with_row = keep is not None

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "text", _TEXTS_BYTES):
                found = shared.value.score([t or "" for t in batch.column("text").to_pylist()])
                arrays, names = [batch.column("doc_id"), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"]
                if with_row:
                    arrays, names = [*arrays, batch.column("row")], [*names, "row"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = StructType.fromDDL("doc_id long, score double, predicted int")
    if with_row:
        schema.add(chosen.schema["row"])
    return chosen.mapInArrow(predict, schema)
