"""Spelling variants, collocations and packing along the curve against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from telewarden.llm import collocations, curve_packing, queries, spelling

SCHEMA = "doc_id long, text string, lang string, word string, n int, row string, id int, key string"
SYLLABLES = ["th", "he", "in", "er", "ble", "on", "ing", "ti", "é", "ñu"]


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "clash", 1, "clash") for r in rows], SCHEMA).repartition(3)


def made_words(rng, n, least=2):
    words = set()
    while len(words) < n:
        word = "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 8)))
        words.add(word)
        k = rng.randrange(len(word))
        words.add(word[:k] + rng.choice(["", "a", "é", "x"]) + word[k + 1 :])
    return sorted(w for w in words if len(w) >= least)


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words):
    known = sorted(words)
    found = {w: [x for x in known if near(w, x)] for w in known}
    form = {}
    for w, others in found.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 2 * words[w]:
            form[w] = best
    rows = set()
    for w in known:
        root = w
        while root in form:
            root = form[root]
        rows.add((w, words[w], len(found[w]), form.get(w), words.get(form.get(w)), root))
    return rows


def variants_of(df):
    return {(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


@pytest.mark.parametrize("places", [3, 16, 60, 400])
def test_near_words_share_a_list(places):
    words = made_words(random.Random(places), 2500)
    counts = Counter()
    for w in words:
        marked = spelling.HEAD + w + spelling.TAIL
        counts.update(marked[i : i + k] for k in range(2, spelling.LONGEST_GRAM) for i in range(len(marked) - k + 1))
    frequent = {g: n for g, n in counts.items() if n > places}
    lists = {w: set(spelling.keys_of(w, frequent)) for w in words}
    holes = defaultdict(set)
    for w in words:
        holes[w].add(w)
        for i in range(len(w)):
            holes[w[:i] + w[i + 1 :]].add(w)
    pairs = {(a, b) for ws in holes.values() for a in ws for b in ws if a < b and near(a, b)}
    assert len(pairs) > 500
    assert all(lists[a] & lists[b] for a, b in pairs)


def test_dictionary_counts_places(spark):
    words = ["ababab", "babab", "xyzzyx", "longerword"]
    table = spark.createDataFrame([(w,) for w in words], "word string")
    counts = Counter()
    for w in words:
        marked = spelling.HEAD + w + spelling.TAIL
        counts.update(marked[i : i + k] for k in range(2, spelling.LONGEST_GRAM) for i in range(len(marked) - k + 1))
    assert spelling.frequent_grams(table, 1) == {g: n for g, n in counts.items() if n > 1}


def test_variants_equal_brute_force(spark):
    rng = random.Random(3)
    words = {w: rng.choice([1, 2, 3, 5, 9, 40]) for w in made_words(rng, 700)}
    rows = [(w, n, "clash") for w, n in words.items()]
    table = spark.createDataFrame([*rows, (None, 5, "x"), ("q", 9, "x")], "word string, n int, near string").repartition(4)
    assert variants_of(spelling.group_variants(table)) == brute_variants(words)


def test_variants_of_nothing_and_repeats(spark):
    schema = "word string, n long"
    assert spelling.group_variants(spark.createDataFrame([], schema)).count() == 0
    repeated = spark.createDataFrame([("other", 2), ("other", 3), ("othr", 1)], schema)
    assert variants_of(spelling.group_variants(repeated)) == {("other", 5, 1, None, None, "other"), ("othr", 1, 1, "other", 5, "other")}


def test_hot_beginning(spark):
    """Thousands of words that begin alike share lists; none is dropped."""
    rng = random.Random(9)
    words = {"commonprefix" + "".join(rng.choice("abc") for _ in range(5)): rng.randint(1, 50) for _ in range(240)}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    assert variants_of(spelling.group_variants(table)) == brute_variants(words)


def test_damaged_runs(spark):
    rows = [(1, "Straße ÀB naïve x2y word", None), (None, "Word word", "en"), (2, None, "en"), (3, "", "en"), (4, " ".join(["other"] * 300), "de"), (4, "other", "de")]
    got = Counter(r["word"] for r in spelling.plant_deletions(spelling.letter_runs(docs_of(spark, rows)), 3).collect())
    expected = Counter()
    for doc_id, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            expected[run if h % 3 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    assert got == expected
    counted = {r["word"]: r["n"] for r in spelling.vocabulary(spark.createDataFrame([(w,) for w in expected.elements()], "word string")).collect()}
    assert counted == {w: n for w, n in expected.items() if n >= 3 and len(w) >= 5}


def brute_collocations(rows, least, best):
    f, totals = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", text or ""):
            words = tuple("".join(c.lower() if c.isascii() else c for c in w) for w in re.findall("[^ \t]+", piece))
            totals[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, words[i : i + k]] += 1
    candidates = {key: n for key, n in f.items() if len(key[1]) > 1 and n >= least}
    found = defaultdict(list)
    for (lang, p), a in candidates.items():
        held = [n for (other, q), n in candidates.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * n >= 80 * a for n in held):
            continue
        score, _, left, right = min(((2_000_000 * a) // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        found[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return {
        (lang, rank, p.decode(), -a, left, right, totals[lang], -score)
        for lang, own in found.items()
        for rank, (score, a, p, left, right) in enumerate(sorted(own)[:best], 1)
    }


@pytest.mark.parametrize(("lookup_rows", "best"), [(collocations.LOOKUP_ROWS, 2000), (-1, 25)])
def test_collocations_equal_brute_force(spark, monkeypatch, lookup_rows, best):
    monkeypatch.setattr(collocations, "LOOKUP_ROWS", lookup_rows)
    monkeypatch.setattr(collocations, "RANKED_ROWS", 40)
    monkeypatch.setattr(collocations, "BUCKET_BYTES", 4000)
    rng = random.Random(12)
    vocabulary = ["the", "of", "The", "ÉTÉ", "in a", "x\ty", "no;stop", "aa aa aa", "new york city", "ﬁn", "e.g."] + [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) + rng.choice(["", "\n", " \r "]), rng.choice(["en", "en", "de", None])) for i in range(60)]
    rows += [(70, None, "en"), (71, "", "fr"), (72, " ".join(rng.choice(vocabulary) for _ in range(4000)), "en"), rows[0], rows[0], (73, "new york city " * 50, "es")]
    got = collocations.collocations(docs_of(spark, rows), least=4, best=best)
    assert {tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()} == brute_collocations(rows, 4, best)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(docs_of(spark, [])).count() == 0
    assert collocations.collocations(docs_of(spark, [(1, None, None), (2, " ... ", "en")])).count() == 0


def test_products_beyond_64_bits(spark):
    phrases = spark.createDataFrame([(1, "en", "a b", [6 * 10**17, 5 * 10**17], [7 * 10**17, 5 * 10**17])], "id int, lang string, phrase string, heads array<long>, tails array<long>")
    assert collocations._scored(phrases, 2).first()["score"] == 2_000_000 * 5 // 13


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 4), (3, 3), (6, 2)])
def test_curve_visits_neighbours(dimensions, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions, indexing="ij"), axis=-1).reshape(-1, dimensions)
    key = curve_packing.hilbert_key(cells, bits)
    assert sorted(key) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def check_pieces(rows, pieces, capacity, path):
    """Each document's ids lie in exactly one piece, pieces lie gapless, sequences are full or a power of two."""
    tokenizer = Tokenizer.from_file(path)
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in rows}
    copies, by_doc, by_sequence = Counter(i for i, _ in rows), defaultdict(Counter), defaultdict(list)
    for p in pieces:
        part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert len(part) == p["length"] > 0
        assert p["ids_crc32"] == zlib.crc32(part.tobytes())
        assert p["doc_tokens"] == len(ids[p["doc_id"]])
        by_doc[p["doc_id"]].update(range(p["start"], p["start"] + p["length"]))
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    for i, n in copies.items():
        assert by_doc[i] == Counter({k: n for k in range(len(ids[i]))})
    for own in by_sequence.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end == capacity or (end < capacity and end & (end - 1) == 0)


def test_curve_packing_holds_every_id(spark, monkeypatch):
    monkeypatch.setattr(curve_packing, "PART_TOKENS", 50)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["the", "house", "of", "naïve", "中文", "x9", "\n\n"]) for _ in range(rng.choice([0, 3, 40, 400])))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "same text " * 90), (103, "same text " * 90), (7, rows[7][1]), (7, rows[7][1])]
    path = public_tokenizers.path(queries.BYTE_VOCABULARY)
    docs = docs_of(spark, [(i, t, "en") for i, t in rows])
    check_pieces(rows, curve_packing.pack(docs, path, 0, 64).collect(), 64, path)
    assert curve_packing.pack(docs.limit(0), path, 0, 64).count() == 0


def test_curve_packing_query(spark, folder):
    docs = queries.table(spark, folder, "documents").select("doc_id", "text", "lang").collect()
    pieces = queries.QUERIES["op13_curve_packing"](spark, folder).collect()
    check_pieces([(r["doc_id"], r["text"]) for r in docs], pieces, 1024, public_tokenizers.path(queries.BYTE_VOCABULARY))
    lang, met = {r["doc_id"]: r["lang"] for r in docs}, defaultdict(set)
    for p in pieces:
        met[p["sequence_id"]].add(p["doc_id"])
    pairs = [(lang[a], lang[b]) for own in met.values() for a in own for b in own if a < b]
    shares = Counter(lang.values())
    by_chance = sum(n * n for n in shares.values()) / len(lang) ** 2
    assert sum(a == b for a, b in pairs) / len(pairs) > (1 + by_chance) / 2


def test_large_ids_are_kept():
    ids = np.array([1, 70_000, 3], "<u4")
    assert curve_packing._widen(curve_packing._narrow(memoryview(ids.tobytes()))).tolist() == [1, 70_000, 3]
    assert curve_packing.powers_of_two(700) == [512, 128, 32, 16, 8, 4]
