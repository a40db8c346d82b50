"""Token counts, token files and packing against the tokenizers library and brute force."""

from __future__ import annotations

import random
import zlib
from array import array
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from telewarden.llm import packing, pfor, pieces, shingles, token_counts, token_files
from telewarden.session import scratch_path

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
PARTS = [
    "a", "B", "é", chr(0x130), "ß", "ñ", "Σ", "ς", "1", "22", "²", "Ⅷ", "'s", "'", "n't", ".", ",", "!!", "$$$", "_", " ", "  ", "\n", "\n\n", " \n", "\t", "\x0b", "\x1c",
    "\x85", "\xa0", chr(0x2003), chr(0x3000), chr(0x301), "e" + chr(0x301), "<|endoftext|>", "<|startoftext|>", "日本", "🙂", "-", "x y", "the", "The idiot", " and",
]


def odd_texts(n: int, seed: int = 3) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize(("path", "kept"), [(WORD, False), (BYTE, True)])
def test_pieces_give_the_ids_of_the_library(path, kept):
    texts = [*odd_texts(3000), "", "word " * 3000]
    want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    for remembered in (10, 100_000):
        assert pieces.PieceEncoder(path, kept, False, remembered)(texts) == [array("I", w.ids).tobytes() for w in want]
        assert pieces.PieceEncoder(path, kept, True, remembered)(texts) == [len(w.ids) for w in want]


def test_segments_cut_at_lone_blanks_only():
    for text in [*odd_texts(300), "x" * 500, "a b " * 200]:
        parts = list(pieces.segments(text, 20))
        assert "".join(parts) == text
        assert all(p[0] == " " and not p[1].isspace() for p in parts[1:])


@pytest.fixture(scope="module")
def odd_docs(spark):
    texts = [None, "", "one two", "one two", "x" * 5000, "many words " * 3000, *odd_texts(40)]
    rows = [(k if k != 7 else None, t, 1, "s", "clash") for k, t in enumerate(texts)]
    rows.append(rows[2])  # a repeated row
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, shard string, start string").repartition(3)


def ids_of(path, text, end):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + end


def test_token_counts(spark, odd_docs):
    got = sorted(map(tuple, token_counts.token_counts(odd_docs, WORD).collect()), key=str)
    want = [(r["doc_id"], len((r["text"] or "").encode()), len(ids_of(WORD, r["text"], []))) for r in odd_docs.collect()]
    assert got == sorted(want, key=str)
    assert token_counts.token_counts(odd_docs.limit(0), WORD).count() == 0


@pytest.mark.parametrize("numbers", [[], [5], [7] * 1000, [0, 2**32 - 1] * 400, list(range(3000))])
def test_blocks_round_trip(numbers):
    a = np.array(numbers, np.uint32)
    assert (pfor.decode(*pfor.encode(a), len(a)) == a).all()


def test_blocks_patch_outliers():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 100, 10_000, dtype=np.uint32)
    a[::50] = rng.integers(2**31, 2**32, 200, dtype=np.uint32)
    blocks, starts = pfor.encode(a)
    assert (pfor.decode(blocks, starts, len(a)) == a).all()
    assert len(blocks) < 10_000 * 7 / 8 + 200 * 5 + 40 * 7 + 300
    assert len(starts) == 4 * 40


def test_token_files(spark, odd_docs):
    where = scratch_path(spark, "test-files")
    token_files.write_token_files(odd_docs, where, WORD, 2)
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_digests(spark, where).collect()]
    rows = sorted(odd_docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, (r["text"] or "").encode()))
    start, want = 0, []
    for r in rows:
        ids = ids_of(WORD, r["text"], [2])
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=str) == sorted(want, key=str)
    empty = scratch_path(spark, "test-files")
    token_files.write_token_files(odd_docs.limit(0), empty, WORD, 2)
    assert token_files.read_digests(spark, empty).count() == 0


def check_packing(rows, capacity):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing(spark, odd_docs):
    rows = packing.pack(odd_docs, BYTE, 0, 64).collect()
    want = []
    for r in odd_docs.collect():
        ids = ids_of(BYTE, r["text"], [0])
        cuts = [0, *range((len(ids) - 1) % 64 + 1, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want.append((r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    assert check_packing(rows, 64) <= -(-sum(r["length"] for r in rows) // 64) + 1
    assert packing.pack(odd_docs.limit(0), BYTE, 0, 64).count() == 0


@pytest.mark.parametrize(
    ("histogram", "best"),
    [({}, 0), ({7: 1}, 1), ({10: 5, 4: 9, 3: 2}, 10), ({6: 1000}, 1000), ({5: 3, 6: 3, 7: 3}, 8), ({n: 40 + n for n in range(1, 11)}, 263)],
)
def test_plans_hold_the_histogram(histogram, best):
    plan, _ = packing.packing_plan(histogram, 10)
    held = defaultdict(int)
    for found, times in plan:
        assert times > 0 and sum(n * c for n, c in found.items()) <= 10
        for length, copies in found.items():
            held[length] += copies * times
    assert held == histogram
    assert sum(times for _, times in plan) <= best * 1.03


def test_best_configuration_is_best():
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = np.unique(rng.integers(1, 12, 4))
        prices = rng.random(len(lengths))
        found = packing.best_filling(packing.knapsack(lengths, prices, 15), lengths, 15)
        best = np.zeros(16)
        for room in range(1, 16):
            best[room] = max([best[room - 1], *(best[room - n] + p for n, p in zip(lengths, prices, strict=True) if n <= room)])
        assert sum(lengths[k] * c for k, c in found.items()) <= 15
        assert sum(prices[k] * c for k, c in found.items()) == pytest.approx(best[15])


@pytest.mark.parametrize(("n", "mu", "sigma"), [(40, 4.2, 1.0), (3000, 4.2, 1.0), (66_000, 4.2, 1.0), (66_000, 5.1, 0.4), (500_000, 4.2, 1.0), (300_000, 3.0, 0.5)])
def test_program_places_nearly_all(n, mu, sigma):
    """The program's own configurations hold at least 90 % of the tokens, in tiny tables less, and together need no more sequences than best-fit alone, but for rounding."""
    capacity = 256
    size = np.maximum(1, np.random.default_rng(n).lognormal(mu, sigma, n).astype(int))
    lengths, counts = np.unique((size - 1) % capacity + 1, return_counts=True)
    histogram = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    plan, programmed = packing.packing_plan(histogram, capacity)
    held = {}
    for found, times in plan:
        assert sum(k * c for k, c in found.items()) <= capacity and times > 0
        for k, c in found.items():
            held[k] = held.get(k, 0) + c * times
    assert held == histogram
    alone = sum(times for _, times in packing.best_fit(lengths, counts.copy(), capacity))
    assert sum(times for _, times in plan) <= alone * 1.0005 + 1
    placed = sum(sum(k * c for k, c in found.items()) * times for found, times in plan[:programmed])
    assert placed >= (0.6 if n < 100 else 0.9) * (lengths * counts).sum()


@pytest.mark.parametrize("kept", [True, False])
def test_memory_is_bounded_by_bytes(kept):
    """Texts without blanks are one piece each; what is remembered of them stays near its bound."""
    path = BYTE if kept else WORD
    limit = 2 << 20
    encoder = pieces.PieceEncoder(path, kept, False, limit)
    for block in range(12):
        encoder([chr(0x4E00 + (block * 97 + k) % 5000) * 2000 for k in range(60)])
        held = sum(len(k) * 2 + len(v) for d in (encoder._pieces, encoder._words) for k, v in d.items())
        assert held < limit + 2 * 60 * 2000 * (2 + 4 * 3)


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr(shingles, "REMEMBERED", 100_000)
    for k in range(40):
        shingles.shingles(" ".join(f"{k}word{i}{'x' * 200}" for i in range(50)))
        assert sum(map(len, shingles._hashes)) < 100_000 + 50 * 220


@pytest.mark.parametrize(("path", "kept"), [(WORD, True), (BYTE, False)])
def test_other_vocabularies_are_encoded_whole(path, kept):
    """Files whose steps are not those the cuts are made for still give the library's ids."""
    encoder = pieces.PieceEncoder(path, kept, False)
    texts = [*odd_texts(300), "", "word " * 200]
    assert not encoder._known and pieces.PieceEncoder(path, not kept, False)._known
    want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert encoder(texts) == [array("I", w.ids).tobytes() for w in want]
