"""Toxicity, language, mixing, sharding, near-duplicate texts and the pipeline against brute force."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from telewarden.llm import language_id, minhash_dedup, mixing, queries, sampling, sharding, shingles, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, score int, row string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA).repartition(3)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_automaton_is_edit_distance():
    rng = random.Random(4)
    entries = [("abcab", False), ("abc", False), ("bbcca", False), ("accbba", False), ("cabcabc", True), ("bca", True)]
    automaton = toxicity.LexiconAutomaton(entries)
    for _ in range(4000):
        word = "".join(rng.choice("abcx") for _ in range(rng.randint(1, 9)))
        best = None
        for k, (text, stem) in enumerate(entries):
            most = 1 if len(text) >= (toxicity.LEAST_STEM if stem else toxicity.LEAST_TERM) else 0
            near = min(edits(word[:n], text) for n in range(len(word) + 1)) if stem else edits(word, text)
            if near <= most and (best is None or (near, k) < (best[1], best[0])):
                best = (k, near)
        assert automaton.match(word) == best, word


def test_quotation_is_not_abuse():
    model = toxicity.ToxicityModel([("scoundrel", False)], np.array([4.0]), np.array([1.0, 2, 1, 1, 1, 0, -3]))
    abuse, misspelt, quoted, clean, again = model.score(["you scoundrel", "you scoundrl", "he said “you scoundrel”, and left", "a fine day", "he said “hello” and you are a scoundrel"])
    assert abuse > misspelt > quoted and abuse > 0.5 > quoted and again > 0.5
    assert clean < 0.1


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    syllables = ["ba", "do", "ki", "lu", "me", "no", "pa", "re", "su", "ti"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for k in range(400):
        words = [word() for _ in range(60)]
        toxic = k % 5 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["villain", "rascals!", "wretch" + word()])
        rows.append((k, " ".join(words), "xx", "s"))
        labels.append((k, int(toxic), "clash"))
    rows += [(400, None, None, None), (401, "", "xx", "s"), (402, "a vilain " + "ba " * 20000, "xx", "s"), rows[5]]
    labels += [(400, 1, "x"), (9999, 0, "x"), (3, None, "x"), (None, 1, "x"), (7, 0, "x")]
    return docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int, text string")


def test_toxicity_of_held_out_rows(labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels, sampling.fold("doc_id", 5) != 0)
    assert {"villain", "rascals"} <= {t for t, stem in model.entries if not stem}
    assert any(stem and t.startswith("wret") for t, stem in model.entries)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == 403 and toxicity.score(docs, model).count() == 404
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum(got[k]["predicted"] == (k % 5 == 0) for k in held) >= 0.97 * len(held)
    assert got[400]["predicted"] == got[401]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())


def test_toxicity_of_little(labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels.limit(0), F.lit(True))
    assert {r["predicted"] for r in toxicity.score(docs, model).collect()} == {0} or model.coefficients[-1] >= 0
    assert toxicity.score(docs.limit(0), model).count() == 0


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(6)
    tongues = {"aa": ["ka", "ro", "mi"], "bb": ["sch", "nut", "lö"], "cc": ["é", "ou", "vre"]}
    rows = []
    for k in range(300):
        lang = "aabbcc"[2 * (k % 3) : 2 * (k % 3) + 2]
        text = " ".join("".join(rng.choice(tongues[lang]) for _ in range(3)) for _ in range(40))
        rows.append((k, text, lang if k % 10 else None, "s"))
    rows += [(300, None, "aa", "s"), (301, "", "aa", "s"), (302, "12 ?! --", "bb", "s"), (303, "k", None, "s"), (304, "karo " * 30000, None, "s"), rows[4]]
    return docs_of(spark, rows)


def test_language_of_held_out_rows(spoken):
    model = language_id.fit(spoken, sampling.fold("doc_id", 4) != 2)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(spoken, model).collect()}
    assert all(got[k][0] == "aabbcc"[2 * (k % 3) : 2 * (k % 3) + 2] for k in range(300))
    assert got[300] == got[301] == got[302] == ("und", 0.0)
    assert got[303][0] in ("aa", "bb", "cc") and got[304][0] == "aa"
    assert all(0 <= s <= 1 for _, s in got.values())


def test_language_counts_are_those_of_sets(spoken):
    texts = [r["text"] for r in spoken.where("text is not null").limit(20).collect()] + ["", "ka" * 5000]
    grams = {lang: {x for t in texts[k::3] for x in language_id.trigrams([t])[0].tolist()} for k, lang in enumerate("xyz")}
    flat = [(g, k) for k, lang in enumerate("xyz") for g in grams[lang]]
    model = language_id.build_filter(list("xyz"), np.array([g for g, _ in flat], np.uint64), np.array([k for _, k in flat]))
    sizes, held = model.counts(texts)
    for row, text in enumerate(texts):
        own = language_id.trigrams([text])[0].tolist()
        assert sizes[row] == len(own) == sum(c.isalpha() for c in text.lower())
        for k, lang in enumerate("xyz"):
            exact = sum(g in grams[lang] for g in own)
            assert held[row, k] == pytest.approx(exact, abs=1 + 0.01 * len(own))


def test_language_of_little(spoken):
    model = language_id.fit(spoken.limit(0), F.lit(True))
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify(spoken, model).collect()} == {("und", 0.0)}
    assert language_id.identify(spoken.limit(0), model).count() == 0


def webster(sizes, seats):
    held = {k: 0 for k in sizes}
    for _ in range(seats):
        held[max(held, key=lambda k: (sizes[k] / (2 * held[k] + 1), [-ord(c) for c in str(k)]))] += 1
    return held


def test_apportionment_by_highest_quotients(spark):
    rng = random.Random(8)
    for parties, seats in ((1, 5), (7, 3), (9, 100), (30, 1000)):
        sizes = {k: rng.random() * 100 for k in range(parties)}
        df = spark.createDataFrame([(k, s * 64 * seats / sum(sizes.values())) for k, s in sizes.items()], "source_no long, target double")
        got = {r["source_no"]: r["blocks"] for r in mixing.apportion_sources(df, 64).collect()}
        assert got == webster(sizes, seats)
        shards = spark.createDataFrame([(0, k, s, sum(sizes.values()), float(seats), float(parties)) for k, s in sizes.items()], "source_no int, shard int, shard_size double, source_size double, source_blocks double, source_shards double")
        assert {r["shard"]: r["blocks"] for r in mixing.apportion_shards(shards).collect()} == webster(sizes, seats)


def test_mixing(spark, monkeypatch):
    rng = random.Random(9)
    rows = []
    for k in range(600):
        source = rng.choice(["hot"] * 8 + ["a", "b", None, "é"])
        rows.append((k, " ".join(["w"] * rng.choice([0, 1, 5, 300, 2000])) if k % 50 else None, "xx", source))
    rows += [rows[3], rows[3]]
    docs = docs_of(spark, rows)
    for shard_docs in (1000, 50):
        monkeypatch.setattr(mixing, "SHARD_DOCS", shard_docs)
        got = [tuple(r) for r in mixing.mix(docs).collect()]
        assert sorted(got, key=str) == sorted((tuple(r) for r in mixing.mix(docs.repartition(7)).collect()), key=str)
        assert len(got) == len(rows)
        size = {k: len((t or "").split()) for k, t, _, _ in rows}
        source_of = {k: s for k, _, _, s in rows}
        totals = Counter()
        for k, _, _, s in rows:
            totals[s] += size[k]
        order = sorted((s for s in totals if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
        weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
        target, capped = {}, set()
        while True:
            free = sum(totals.values()) - sum(3 * totals[s] for s in capped)
            target = {s: 3 * totals[s] if s in capped else free * weight[s] / sum(weight[x] for x in totals if x not in capped) for s in totals}
            above = {s for s in totals if target[s] > 3 * totals[s]}
            if not above:
                break
            capped |= above
        taken = Counter()
        for doc_id, words, source_size, goal, took in got:
            s = source_of[doc_id]
            assert words == size[doc_id] and source_size == totals[s] and goal == pytest.approx(target[s])
            assert 0 <= took <= 3 * words
            taken[s] += took
        for s in totals:
            assert abs(taken[s] - target[s]) <= 0.03 * target[s] + 32
    assert mixing.mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("shard_docs", [10, 1])
def test_small_source_of_a_large_table_meets_its_target(spark, monkeypatch, shard_docs):
    monkeypatch.setattr(mixing, "SHARD_DOCS", shard_docs)
    small = F.col("id") < 1000
    docs = spark.range(41_000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), F.when(small, 10).otherwise(1)).alias("text"), F.when(small, "b").otherwise("a").alias("source")
    )
    for weights, repeats in (((1.0, 0.42), 1.5), ((1.0, 9.0), 3.0)):
        rows = mixing.mix(docs, weights=weights).where("doc_id < 1000").select("size", "source_size", "target", "taken").collect()
        target = rows[0]["target"]
        assert target == pytest.approx(repeats * 10_000, rel=0.02) and rows[0]["source_size"] == 10_000
        assert abs(sum(r["taken"] for r in rows) - target) <= 33
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)


def test_words_above_a_shards_most_go_to_the_others(spark):
    rng = random.Random(12)
    for seats, factor in ((40, 1), (900, 1), (10**6, 10**7)):
        sizes = [rng.choice([0, 1, 3, 20, 700]) * factor for _ in range(60)]
        blocks = [0] * 60
        for _ in range(60):
            blocks[rng.randrange(60)] += seats // 60 * factor
        rows = [(5, k, n, sum(sizes), sum(blocks), b) for k, (n, b) in enumerate(zip(sizes, blocks, strict=True))]
        df = spark.createDataFrame(rows, "source_no long, shard long, shard_size long, source_size long, source_blocks long, blocks long")
        words = {r["shard"]: r["words"] for r in mixing.shard_words(df.repartition(4), 64, 3).collect()}
        assert sum(words.values()) == min(sum(blocks) * 64, 3 * sum(sizes))
        assert all(min(blocks[k] * 64, 3 * sizes[k]) <= w <= 3 * sizes[k] for k, w in words.items())


def test_lookup_table():
    names = [f"s{k}" for k in range(7)]
    table = sharding.lookup_table(names, 1009)
    counts = Counter(table.tolist())
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table.tolist(), fewer.tolist(), strict=True) if a != 6)
    assert moved < 0.2 * 1009
    heavy = Counter(sharding.lookup_table(names, 1009, [4, 1, 1, 1, 1, 1, 1]).tolist())
    assert heavy[0] == pytest.approx(4 * heavy[1], rel=0.05)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a", "a"], 11)


def test_placement(spark):
    docs = docs_of(spark, [(k % 40, "t" * k, None, None) for k in range(50)] + [(None, "x", None, None), (None, None, None, None)])
    names = ["a", "b", "c"]
    table = sharding.lookup_table(names, 101)
    got = sharding.place(docs, names, slots=101).collect()
    assert len(got) == 52 and all(r["shard"] == names[table[r["slot"]]] for r in got)
    places = defaultdict(set)
    for r in got:
        places[r["doc_id"]].add(r["slot"])
    assert all(len(places[k]) == 1 for k in range(40)) and len(places[None]) == 2
    assert sorted(r["row_bytes"] for r in got) == sorted([*range(50), 1, 0])
    assert sharding.place(docs.limit(0), names).count() == 0


@pytest.fixture(scope="module")
def copied(spark):
    rng = random.Random(10)
    words = [f"w{k}" for k in range(3000)]
    rows, k = [], 0
    for group in range(25):
        base = [rng.choice(words) for _ in range(120)]
        for copy in range(rng.choice([1, 2, 3, 8])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                own[rng.randrange(120)] = rng.choice(words)
            rows.append((k, " ".join(own), "xx", f"s{group}-{copy}"))
            k += 1
    for _ in range(60):  # a large group of near copies that are not all near to each other
        own = list(base)
        for _ in range(rng.choice([1, 3, 6, 10])):
            own[rng.randrange(120)] = rng.choice(words)
        rows.append((k, " ".join(own), "xx", "s"))
        k += 1
    extra = [None, "", "", " ", "one two", "one  TWO", "one", "?? !!", "?? !!", "long " * 30000, "long " * 30000]
    rows += [(k + i, t, None, None) for i, t in enumerate(extra)]
    rows += [rows[0], rows[0], (None, rows[1][1], None, None), (2, "another text under an id that is taken already", None, None)]
    return docs_of(spark, rows)


@pytest.mark.parametrize("chunk", [400, 5])
def test_near_duplicate_texts(copied, monkeypatch, chunk):
    monkeypatch.setattr(minhash_dedup, "CHUNK_MEMBERS", chunk)
    weights = minhash_dedup.document_frequencies(copied)
    rows = [(r["doc_id"], r["text"]) for r in copied.collect()]
    bags = [weights.bag(t or "") for _, t in rows]
    label = list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i][1], rows[j][1]
            if a is not None and b is not None and (a == b or shingles.weighted_jaccard(bags[i], bags[j]) >= 0.8):
                label[max(root(i), root(j))] = min(root(i), root(j))
    ids = defaultdict(list)
    for k, (doc_id, _) in enumerate(rows):
        ids[root(k)].append(doc_id)
    smallest = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    want = Counter((doc_id, text, smallest[root(k)]) for k, (doc_id, text) in enumerate(rows))
    found = minhash_dedup.near_duplicates(copied)
    got = found.join(copied.select(minhash_dedup.text_key().alias("key"), "text").distinct(), "key", "left").collect()
    assert Counter((r["doc_id"], r["text"], r["component_id"]) for r in got) == want
    assert len({r["component_id"] for r in got if r["kept"]}) == len({r["component_id"] for r in got})
    assert all(r["doc_id"] == r["component_id"] for r in got if r["kept"])


def test_draws_agree_as_often_as_bags_are_similar():
    rng = np.random.default_rng(3)
    sampler = minhash_dedup.Sampler()
    agreed, want = [], []
    for _ in range(150):
        n, shared = 200, int(rng.integers(20, 180))
        a = np.sort(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.sort(np.concatenate([a[:shared], rng.integers(0, 2**63, n - shared).astype(np.uint64)]))
        wa, wb = rng.choice([1.0, 1.3, 2.0, 4.0], n), rng.choice([1.0, 1.3, 2.0, 4.0], n)
        draws = sampler.draws([(a, wa), (b, wb)])
        agreed.append((draws[0] == draws[1]).mean())
        want.append(shingles.weighted_jaccard((a, wa), (b, wb)))
    assert np.mean(agreed) == pytest.approx(np.mean(want), abs=0.02)
    assert np.corrcoef(agreed, want)[0, 1] > 0.9


def test_no_near_duplicates_of_nothing(copied):
    assert minhash_dedup.near_duplicates(copied.limit(0)).count() == 0
    assert minhash_dedup.near_duplicates(copied.where("text is null")).collect()[0]["kept"]


def test_pipeline_stages(spark, folder, copied):
    docs = copied.withColumn("taken", F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), folder).count() == 0
    before = Counter(r["doc_id"] for r in copied.collect())
    kept = corpus_pipeline.drop_near_duplicates(spark, copied, folder).collect()
    assert Counter(r["doc_id"] for r in kept).most_common(1)[0][1] <= 2 and before[0] == 3  # id 2 has two texts
    groups = {(r["component_id"], r["key"] if r["doc_id"] is None else None) for r in minhash_dedup.near_duplicates(copied).collect()}
    assert len(kept) >= len({c for c, _ in groups})
    mixed = corpus_pipeline.mix_sources(spark, copied, folder).collect()
    texts = {(r["doc_id"], r["text"]) for r in copied.collect()}
    assert {(r["doc_id"], r["text"]) for r in mixed} <= texts and max(Counter((r["doc_id"], r["text"]) for r in mixed).values()) <= 9


def test_copies_of_uneven_texts_meet_what_the_mix_takes(spark, folder):
    rng = random.Random(13)
    rows = []
    for s in range(40):
        for size in [rng.randint(4000, 9000), *rng.sample(range(1, 60), 25)]:
            rows.append((len(rows), "w " * size, "xx", f"s{s:02}"))
    rows += [(len(rows), "", "xx", "s00"), (len(rows) + 1, None, "xx", "s01")]
    docs = docs_of(spark, rows)
    source_of, size_of = {r[0]: r[3] for r in rows}, {r[0]: len((r[1] or "").split()) for r in rows}
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs, seed=corpus_pipeline.MIX_SEED).collect()}
    want, words, target = Counter(), Counter(), Counter()
    for s in sorted(set(source_of.values())):  # one stream per source
        upto = 1 << 29
        for k in sorted((k for k in taken if source_of[k] == s and size_of[k]), key=lambda k: -size_of[k]):
            before, upto = upto, upto + (taken[k] << 30) // size_of[k]
            want[k] = (upto >> 30) - (before >> 30)
            words[s], target[s] = words[s] + want[k] * size_of[k], target[s] + taken[k]
    got = Counter(r["doc_id"] for r in corpus_pipeline.mix_sources(spark, docs, folder).select("doc_id").collect())
    for s in target:
        out = sum(n * size_of[k] for k, n in got.items() if source_of[k] == s)
        assert abs(out - target[s]) <= 0.5 * max(n for k, n in size_of.items() if source_of[k] == s) + 1, s
    assert got == +want and words == Counter({s: sum(n * size_of[k] for k, n in got.items() if source_of[k] == s) for s in target})


def test_pipeline_runs(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    total, sequences = sum(r["length"] for r in rows), {r["sequence_id"] for r in rows}
    assert len(sequences) <= math.ceil(total / queries.SEQUENCE_TOKENS) * 1.05 + 1
    again = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows) == Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in again)


def test_entry_names_the_operators():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {n for n in names if n.startswith("op") and n[2].isdigit()} == set(queries.QUERIES) and len(queries.QUERIES) == 10 and "pipeline" in names
