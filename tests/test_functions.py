from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from telewarden.functions.ordered import chunk_window, frame_chunks, last_known, own_rows, with_position
from telewarden.functions.prefix import running_totals, value_ranges
from telewarden.functions.quantiles import exact_quantiles
from telewarden.functions.skew import find_hot_keys, hash_subsamples, lookup_join
from telewarden.functions.text_codes import hash_code, string_hash

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one entity, bursts, equal times, a null entity and gaps."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(3000):
        entity = "hot" if i % 3 == 0 else None if i % 50 == 1 else f"e{rng.integers(0, 20)}"
        second = int(rng.integers(0, 40)) if i % 2 else int(rng.integers(0, 100_000))
        rows.append((i, entity, START + dt.timedelta(seconds=second), float(rng.normal()) if rng.random() > 0.6 else None))
    return spark.createDataFrame(rows, "id int, entity string, ts timestamp, x double").repartition(7).cache()


def as_set(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("bucket_rows", [15, 100, 1_000_000])
def test_position_equals_plain_window(skewed, bucket_rows):
    hit = F.coalesce(F.col("x") > 0, F.lit(False))
    ours = with_position(skewed, ["entity"], ["ts", "id"], "ts", running={"hits": hit}, bucket_rows=bucket_rows)
    w = Window.partitionBy("entity").orderBy("ts", "id")
    plain = skewed.select("id", (F.row_number().over(w) - 1).alias("pos"), F.count_if(hit).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("hits"))
    assert as_set(ours.select("id", "pos", "hits")) == as_set(plain)


def test_global_position(skewed):
    ours = with_position(skewed, [], ["ts", "id"], "ts", bucket_rows=40).select("id", "pos")
    plain = skewed.select("id", (F.row_number().over(Window.orderBy("ts", "id")) - 1).alias("pos"))
    assert as_set(ours) == as_set(plain)


@pytest.mark.parametrize(("frame", "chunk_rows"), [(1, 5), (4, 3), (5, 17), (60, 10)])
def test_frames_equal_plain_window(skewed, frame, chunk_rows):
    chunks = frame_chunks(skewed, ["entity"], ["ts", "id"], "ts", frame, chunk_rows=chunk_rows, bucket_rows=50)
    ids = F.collect_list("id").over(chunk_window(["entity"]).rowsBetween(-(frame - 1), 0))
    ours = own_rows(chunks.withColumn("ids", ids)).select("id", "ids")
    w = Window.partitionBy("entity").orderBy("ts", "id").rowsBetween(-(frame - 1), 0)
    assert as_set(ours) == as_set(skewed.select("id", F.collect_list("id").over(w).alias("ids")))


@pytest.mark.parametrize("bucket_rows", [15, 100, 1_000_000])
def test_last_known_equals_plain_window(skewed, bucket_rows):
    ours = last_known(skewed, ["x"], ["entity"], ["ts", "id"], "ts", bucket_rows=bucket_rows).select("id", "x")
    w = Window.partitionBy("entity").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    assert as_set(ours) == as_set(skewed.select("id", F.last("x", ignorenulls=True).over(w)))


def test_one_instant_is_cut_by_the_rest_of_the_order(skewed):
    burst = skewed.withColumn("ts", F.lit("2024-01-01").cast("timestamp")).withColumn("entity", F.lit("hot"))
    ours = with_position(burst, ["entity"], ["ts", "id"], "ts", bucket_rows=100)
    assert sorted(r.pos - r.id for r in ours.select("id", "pos").collect()) == [0] * 3000


def test_order_functions_on_empty_and_single_rows(spark, skewed):
    empty = skewed.where("id < 0")
    assert with_position(empty, ["entity"], ["ts", "id"], "ts").count() == 0
    one = skewed.where("id = 5")
    assert [r.pos for r in with_position(one, ["entity"], ["ts", "id"], "ts").collect()] == [0]
    assert last_known(one, ["x"], ["entity"], ["ts", "id"], "ts").count() == 1


@pytest.mark.parametrize("in_memory", [5, 3_000, 1_000_000])
def test_quantiles_equal_numpy(spark, in_memory):
    rng = np.random.default_rng(1)
    columns = {
        "smooth": rng.normal(size=4000),
        "ties": rng.integers(0, 4, 4000).astype(float),
        "skewed": np.where(rng.random(4000) < 0.99, 0.0, rng.random(4000)),
    }
    df = spark.createDataFrame(list(zip(*[c.tolist() for c in columns.values()])), ", ".join(f"{c} double" for c in columns))
    df = df.unionByName(spark.createDataFrame([(None, None, None)], df.schema))
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.995, 1.0]
    found = exact_quantiles(df, list(columns), probs, in_memory=in_memory)
    for name, values in columns.items():
        assert found[name] == pytest.approx(np.percentile(values, [p * 100 for p in probs]).tolist(), abs=1e-12), name


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert exact_quantiles(df, ["x"], [0.5])["x"] == [None]


@pytest.mark.parametrize("descending", [True, False])
def test_running_totals(spark, descending):
    rng = np.random.default_rng(5)
    values = sorted(set((rng.random(2000) ** 6).tolist()))
    df = spark.createDataFrame([(v, int(rng.integers(0, 9))) for v in values], "v double, n int").repartition(5).cache()
    cuts = value_ranges(df, "v", rows_per_range=100)
    assert len(cuts) > 5
    ours = running_totals(df, "v", ["n"], cuts, descending=descending)
    order = F.col("v").desc() if descending else F.col("v")
    plain = df.withColumn("c", F.sum("n").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    assert as_set(ours.select("v", "cum_n")) == as_set(plain.select("v", "c"))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_join_with_hot_and_missing_keys(spark, how):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, F.lit(None)).otherwise((F.col("id") % 997).cast("string")).alias("k"))
    right = spark.range(900).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v")).union(spark.createDataFrame([("hot", -1)], "k string, v long"))
    assert [r.k for r in find_hot_keys(left, ["k"], 20).collect()] == ["hot"]
    plain = as_set(left.join(right, ["k"], how).select("id", "k", "v"))
    for small_rows in (10, 10_000):
        ours = lookup_join(left, right, ["k"], how, limit=20, salts=4, small_rows=small_rows)
        assert as_set(ours.select("id", "k", "v")) == plain


def test_no_hot_keys(spark):
    left = spark.range(1000).select("id", (F.col("id") % 500).alias("k"))
    assert find_hot_keys(left, ["k"], 20) is None


@pytest.mark.parametrize("n", [300, 20_000])
def test_subsamples_do_not_depend_on_partitioning(spark, n):
    df = spark.range(n)
    draw = lambda parts: hash_subsamples(df.repartition(parts), "id", 6, 50, 9, group_col="g").select("g", "id", "_rank")
    first = as_set(draw(2))
    assert first == as_set(draw(5))
    sizes = {}
    for g, i, _ in first:
        sizes.setdefault(g, set()).add(i)
    assert {g: len(v) for g, v in sizes.items()} == dict.fromkeys(range(6), 50)


def jvm_hash(text: str) -> int:
    h = 0
    units = text.encode("utf-16-be")
    for i in range(0, len(units), 2):
        h = (h * 31 + int.from_bytes(units[i : i + 2], "big")) & 0xFFFFFFFF
    return h - (1 << 32) if h >= 1 << 31 else h


def test_string_hash(spark):
    # "polygenelubricants" hashes to the smallest 32-bit integer.
    words = ["", "get", "user-1234", "é", "a😀é", "polygenelubricants", "port-forward", "日本語"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    rows = df.select("w", string_hash(F.col("w")).alias("h"), hash_code(F.col("w"), 20).alias("c")).collect()
    for r in rows:
        assert r.h == jvm_hash(r.w), r.w
        assert r.c == (-8 if r.w == "polygenelubricants" else abs(r.h) % 20), r.w
    assert {r.w: r.h for r in rows}["polygenelubricants"] == -(1 << 31)
