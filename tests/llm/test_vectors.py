"""Searches and near-duplicate vectors against brute force, and connected components."""

from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from telewarden.llm import components, embedding_dedup, queries, topk_search
from telewarden.session import cut_lineage


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(1)
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    rows = [(k, [x + rng.gauss(0, 0.15) for x in base[k % 12]], 0) for k in range(150)]
    rows += [(150 + k, list(base[0]), 0) for k in range(30)]  # copies
    odd = [None, [], [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [float("inf")] + [0.0] * 5, [0.0] * 6, [1.0, 2.0], [2.0, 4.0], [1e300] * 6, [-0.0, 1.0, 0.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0, 0.0, 0.0]]
    rows += [(180 + k, v, 1) for k, v in enumerate(odd)]
    rows += [rows[20], rows[40]]  # repeated rows
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").repartition(3)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def test_top_k(vectors):
    df = vectors.where(F.col("vec_id") != 188)  # its scaled components don't fit a long
    rows = [(r["vec_id"], [math.floor(64 * x) for x in r["embedding"]]) for r in df.collect() if usable(r["embedding"])]
    want = []
    for i, (q, a) in enumerate(rows):
        if q % 20 == 0:
            scores = [(sum(x * y for x, y in zip(a, b, strict=True)), v) for j, (v, b) in enumerate(rows) if j != i and len(a) == len(b)]
            want += [(q, k + 1, v, s) for k, (s, v) in enumerate(sorted(scores, key=lambda p: (-p[0], p[1]))[:20])]
    got = [tuple(r) for r in topk_search.top_k(df, F.col("vec_id") % 20 == 0, 20).collect()]
    assert sorted(got) == sorted(want)


def test_top_k_in_small_blocks(vectors, monkeypatch):
    for name, value in {"BLOCK_ROWS": 4, "GROUP_ROWS": 25, "TILE_ROWS": 3, "CELLS": 3}.items():
        monkeypatch.setattr(topk_search, name, value)
    test_top_k(vectors)


def test_top_k_of_little(spark, vectors):
    assert topk_search.top_k(vectors.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0
    huge = spark.createDataFrame([(0, [1e18, -1e18]), (1, [1e18, 3.0]), (2, [-1e18, 1.0])], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["score"] for r in topk_search.top_k(huge, F.col("vec_id") == 0, 5).collect()}
    assert got == {1: 2**63 - 1, 2: -(2**63)}


def brute_components(n, linked):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i, j in linked:
            low = min(label[i], label[j])
            if label[i] != low or label[j] != low:
                label[i] = label[j] = low
                changed = True
    return label


@pytest.mark.parametrize("settings", [{}, {"LEAST_CHUNK_ROWS": 10, "CHUNK_ROWS": 20, "PART_ROWS": 7, "GATHERED": 5, "AXES": (1, 2, 4), "LINKS_HELD": 3}])
def test_near_duplicate_vectors(vectors, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(embedding_dedup, name, value)
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    live = [usable(v) and any(x != 0 for x in v) for _, v in rows]

    def cosine(a, b):
        a, b = np.array(a) / np.abs(a).max(), np.array(b) / np.abs(b).max()
        return a @ b / math.sqrt(a @ a) / math.sqrt(b @ b)

    n = len(rows)
    links = [(i, j) for i in range(n) for j in range(i + 1, n) if live[i] and live[j] and len(rows[i][1]) == len(rows[j][1]) and cosine(rows[i][1], rows[j][1]) >= 0.9]
    label = brute_components(n, links)
    count = [sum(i in p for p in links) for i in range(n)]
    smallest = {k: min(rows[i][0] for i in range(n) if label[i] == k) for k in set(label)}
    want = [(rows[i][0], count[i], smallest[label[i]], rows[i][0] == smallest[label[i]]) for i in range(n)]
    got = [tuple(r) for r in embedding_dedup.near_duplicates(vectors, 0.9).collect()]
    assert sorted(got) == sorted(want)
    assert len(links) > 300 and len(set(label)) > 5


def test_near_duplicates_of_nothing(vectors):
    assert embedding_dedup.near_duplicates(vectors.limit(0)).count() == 0
    assert embedding_dedup.near_duplicates(vectors.where("embedding is null")).collect()[0]["kept"]


@pytest.mark.parametrize("name", ["op2_block_topk", "op5_embedding_dedup"])
def test_sql(spark, folder, name):
    got = queries.QUERIES[name](spark, folder)
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    want = con.sql(f"select {', '.join(got.columns)} from ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(2)
    edges = {
        "chain": [(k, k + 1) for k in range(200)] + [(300 + k, 301 + k) for k in range(5)],
        "star": [(500, k) for k in range(300)],
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)],
        "none": [],
    }[shape]
    df = cut_lineage(spark.createDataFrame(edges, "a long, b long"))
    got = {r["node"]: r["root"] for r in components.connected_components(df).collect()}
    label = brute_components(600, edges)
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert set(got) == nodes
    assert {frozenset(x for x in nodes if got[x] == r) for r in set(got.values())} == {frozenset(x for x in nodes if label[x] == r) for r in {label[x] for x in nodes}}
