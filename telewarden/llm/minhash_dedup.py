"""Near-duplicate documents by consistent weighted sampling.

Shingles of five words weigh their count in the text times an inverse document frequency. Improved consistent weighted sampling
draws from each text's weighted bag so that two texts draw alike with the probability of their weighted Jaccard similarity. Bands
of draws make buckets, and texts that share a bucket are compared exactly.

A bucket never becomes all its pairs. Its members meet one of them, the pivot; those found similar are one component, and pairs within it need no
comparison. Buckets whose members stay apart are compared in tiles of bounded size that return links of a forest
only.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telewarden.llm import shingles
from telewarden.llm.components import connected_components
from telewarden.llm.token_counts import byte_slices
from telewarden.session import cut_lineage

SIMILARITY = 0.8
#: Bands and draws of a band: a pair at the least similarity shares a bucket with probability 0.998, at 0.85 with 0.9999.
BANDS, ROWS = 12, 4
#: Counters of document frequencies, a fixed number, cut into slices; frequencies below this share weigh alike.
COUNTERS, SLICES, LEAST_FREQUENCY = 1 << 18, 64, 0.01
#: Slices added up in two steps, so that no task gets those of all scan tasks.
FAN_IN = 64
#: Members of a bucket's chunk, two of which meet in a task.
CHUNK_MEMBERS = 250
_DRAWS = BANDS * ROWS
_TABLE = 1 << 16
_BAGS = 256


class Weights:
    """Weight of a shingle from 1, in every document, to 2, in at most ``LEAST_FREQUENCY`` of them.

    Document frequencies are hashed counts over all documents less what other shingles put into a counter on average.
    """

    def __init__(self, counts: np.ndarray, documents: int):
        noise = counts.sum() / COUNTERS
        share = np.clip((counts - noise) / max(1, documents), LEAST_FREQUENCY, 1.0)
        self.of_counter = (1 + np.log(share) / np.log(LEAST_FREQUENCY)).astype(np.float32)

    def bag(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        hashes, counts = shingles.shingles(text)
        return hashes, counts * self.of_counter[counter_of(hashes)].astype(np.float64)


def counter_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(COUNTERS - 1)).astype(np.int64)


class Sampler:
    """Improved consistent weighted sampling with the random numbers of a shingle and a draw taken from fixed tables by hash.

    For weight w a draw has r and c from Gamma(2, 1) and b uniform, t = floor(ln w / r + b) and ln a = ln c - r (t - b) - r; the
    shingle of least a is drawn. The value itself stands for the drawn shingle and its t.
    """

    def __init__(self, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.log_c = np.log(rng.gamma(2, 1, _TABLE)).astype(np.float32)
        self.r, self.b = rng.gamma(2, 1, _TABLE), rng.random(_TABLE)
        self.factors = rng.integers(1 << 62, 1 << 63, _DRAWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.usual = self._shift(2.0, np.arange(_TABLE)).astype(np.float32)  # a weight that most shingles have

    def _shift(self, weight: np.ndarray | float, at: np.ndarray) -> np.ndarray:
        r, b = self.r[at], self.b[at]
        return r * (np.floor(np.log(weight) / r + b) - b) + r

    def draws(self, bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """A row of drawn values per bag; bags must not be empty."""
        hashes = np.concatenate([h for h, _ in bags])
        weights = np.concatenate([w for _, w in bags])
        starts = np.concatenate([[0], np.cumsum([len(h) for h, _ in bags])[:-1]])
        other = np.flatnonzero(weights != 2.0)
        out = np.empty((len(bags), _DRAWS), np.float32)
        for k, factor in enumerate(self.factors):
            mixed = hashes * factor
            mixed ^= mixed >> np.uint64(31)
            mixed *= factor
            low = ((mixed >> np.uint64(32)) & np.uint64(_TABLE - 1)).astype(np.int64)
            value = self.log_c[(mixed >> np.uint64(48)).astype(np.int64)]
            shift = self.usual[low]
            if len(other):
                shift[other] = self._shift(weights[other], low[other])
            out[:, k] = np.minimum.reduceat(value - shift, starts)
        return out


def bands_of(draws: np.ndarray) -> np.ndarray:
    """One hash per band, different for equal draws in different bands."""
    bits = draws.view(np.uint32).astype(np.uint64).reshape(len(draws), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), bits.shape[:2]).copy()
    for k in range(ROWS):
        out = (out ^ bits[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.astype(np.int64)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> Weights:
    """Hashed document frequencies over all rows; ``COUNTERS`` numbers reach the driver."""
    width = COUNTERS // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(COUNTERS, np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                np.add.at(counts, counter_of(shingles.shingles(text)[0]), 1)
                rows += 1
        task = TaskContext.get().partitionId() % FAN_IN
        parts = [counts[k * width : (k + 1) * width].astype(np.int32).tobytes() for k in range(SLICES)]
        columns = [pa.array(range(SLICES), pa.int32()), pa.array([task] * SLICES, pa.int32()), pa.array([rows] * SLICES, pa.int64()), pa.array(parts, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["slice", "part", "documents", "counts"])

    def add(kind: type) -> object:
        def added(table: pa.Table) -> pa.Table:
            total = np.zeros(width, np.int64)
            for chunk in table.column("counts").to_pylist():
                total += np.frombuffer(chunk, kind)
            columns = [[table.column("slice")[0].as_py()], [table.column("part")[0].as_py()], [pa.compute.sum(table.column("documents")).as_py()], [total.tobytes()]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["slice", "part", "documents", "counts"])

        return added

    schema = "slice int, part int, documents long, counts binary"
    each = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text")).mapInArrow(count, schema)
    first = each.groupBy("slice", "part").applyInArrow(add(np.int32), schema)
    rows = first.groupBy("slice").applyInArrow(add(np.int64), schema).collect()
    counts = np.zeros(COUNTERS, np.int64)
    for row in rows:
        counts[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(row["counts"], np.int64)
    return Weights(counts, max((row["documents"] for row in rows), default=0))


def text_key() -> Column:
    return F.unhex(F.md5("text"))


def signatures(docs: DataFrame, weights: Weights, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, key, bands`` per row: the hash of the text, and its band hashes, none for a text without words."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for whole in batches:
            for batch in byte_slices(whole, "text", 1 << 20):
                bags = [shared.value.bag(t) if t else (np.zeros(0, np.uint64), np.zeros(0)) for t in batch.column("text").to_pylist()]
                live = [k for k, (h, _) in enumerate(bags) if len(h)]
                bands: list[np.ndarray | None] = [None if t is None else np.zeros(0, np.int64) for t in bags]
                if live:
                    for k, row in zip(live, bands_of(sampler.draws([bags[k] for k in live])), strict=True):
                        bands[k] = row
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "key", "bands"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("key", text_key())
    return chosen.select("doc_id", "key", "text").mapInArrow(sign, "doc_id long, key binary, bands array<long>")


def similarities(pairs: DataFrame, texts: DataFrame, weights: Weights) -> DataFrame:
    """``a, b, similarity`` of each pair of nodes, by exact weighted Jaccard similarity of their whole texts.

    ``texts`` has one row per node. A pivot in many pairs is one row joined to many, which Spark splits; its bag is kept while
    pairs of it follow each other.
    """
    shared = pairs.sparkSession.sparkContext.broadcast(weights)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[int, tuple[np.ndarray, np.ndarray]] = OrderedDict()

        def bag(node: int, text: str) -> tuple[np.ndarray, np.ndarray]:
            if node not in kept:
                kept[node] = shared.value.bag(text)
                if len(kept) > _BAGS:
                    kept.popitem(last=False)
            kept.move_to_end(node)
            return kept[node]

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            found = [
                shingles.weighted_jaccard(bag(x, batch.column("ta")[k].as_py()), bag(y, batch.column("tb")[k].as_py())) for k, (x, y) in enumerate(zip(a, b, strict=True))
            ]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], ["a", "b", "similarity"])

    one = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(compare, "a long, b long, similarity double")


def bag_links(bags: list[tuple[np.ndarray, np.ndarray]], least: float) -> np.ndarray:
    """For each bag the first one reachable over similarities of ``least`` or more.

    Shared weights are added up shingle by shingle, over the bags that hold it.
    """
    n = len(bags)
    owner = np.repeat(np.arange(n), [len(h) for h, _ in bags])
    hashes, weights = np.concatenate([h for h, _ in bags]), np.concatenate([w for _, w in bags])
    order = np.argsort(hashes, kind="stable")
    hashes, weights, owner = hashes[order], weights[order], owner[order]
    begins = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, int)
    sizes = np.diff(np.concatenate([begins, [len(hashes)]]))
    shared = np.zeros((n, n))
    for begin, size in zip(begins[sizes > 1], sizes[sizes > 1], strict=True):
        who, weight = owner[begin : begin + size], weights[begin : begin + size]
        if size == n:
            shared += np.minimum(weight[:, None], weight[None, :])
        else:
            shared[who[:, None], who] += np.minimum(weight[:, None], weight[None, :])
    total = np.array([w.sum() for _, w in bags])
    linked = shared >= least * (total[:, None] + total[None, :] - shared)
    linked &= shared > 0
    label = np.arange(n)
    while True:
        low = np.where(linked, label[None, :], n).min(axis=1, initial=n)
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _tile_links(members: DataFrame, texts: DataFrame, weights: Weights, least: float) -> DataFrame:
    """Links ``a, b`` that connect all linked members of each bucket, from ``bucket, node, m`` with the bucket's size ``m``.

    A bucket is cut into chunks of bounded size by hash, and each two chunks meet in a task, which returns a forest and never pairs.
    """
    shared = members.sparkSession.sparkContext.broadcast(weights)

    def compare(table: pa.Table) -> pa.Table:
        nodes, at = np.unique(table.column("node").to_numpy(), return_index=True)
        text = table.column("text")
        root = bag_links([shared.value.bag(text[int(k)].as_py()) for k in at], least)
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.Table.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], ["a", "b"])

    chunks = F.ceil(F.col("m") / CHUNK_MEMBERS).cast("int")
    cut = members.withColumn("chunk", F.pmod(F.xxhash64("node", "bucket"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    tiles = cut.select("bucket", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "node")
    return tiles.join(texts, "node").groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long")


def _links(members: DataFrame, texts: DataFrame, weights: Weights, least: float) -> DataFrame:
    """Verified links between texts that share a bucket, enough of them to connect all that are linked.

    In a turn the members of a bucket meet its pivot. Turns go on as long as they at least halve the pairs of members in different
    components; buckets that then still hold some are compared in tiles.
    """
    found = members.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    roots: DataFrame | None = None
    left, before, seed = members, float("inf"), 0
    while True:
        if roots is None:
            placed = left.withColumn("root", F.col("node"))
        else:
            placed = left.join(roots.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").withColumn("root", F.coalesce("root", "node")).drop("n")
            placed = cut_lineage(placed, "members")
        parts = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("node", F.lit(seed)).alias("h"), F.col("node").alias("node"))).alias("p"))
        buckets = parts.groupBy("bucket").agg(
            F.sum("n").alias("m"),
            ((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("pairs"),
            F.min(F.struct(F.col("p.h").alias("h"), F.col("p.node").alias("node"), F.col("root").alias("root"))).alias("pivot"),
        )
        open_ = cut_lineage(buckets.where("pairs > 0").select("bucket", "m", "pairs", F.col("pivot.node").alias("pivot"), F.col("pivot.root").alias("pivot_root")), "open-buckets")
        pairs_left = float(open_.agg(F.sum("pairs")).first()[0] or 0)
        if not pairs_left:
            return found
        met = placed.join(open_, "bucket")
        if pairs_left > before / 2:
            return found.unionByName(_tile_links(met.select("bucket", "node", "m"), texts, weights, least))
        pairs = met.where("root <> pivot_root").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
        checked = similarities(cut_lineage(pairs, "pairs"), texts, weights)
        linked = cut_lineage(checked.where(F.col("similarity") >= least).select("a", "b"), "verified")
        found = found.unionByName(linked)
        roots = cut_lineage(connected_components(found), "roots")
        left, before, seed = met.where("node <> pivot").select("bucket", "node"), pairs_left, seed + 1


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, *, id_col: str = "doc_id", text_col: str = "text", weights: Weights | None = None) -> DataFrame:
    """``doc_id, key, copy_id, component_id, kept`` for each row of ``docs``.

    ``copy_id`` is the smallest id of a document of equal text, ``component_id`` the smallest one reachable over links of similarity ``least``
    or more, and ``kept`` marks it. Equal texts are one node, so copies are never compared. A null text takes no part and
    is kept; texts without words are linked by equality only. Repeated rows get equal results, so all of them are marked if one is;
    a null id never becomes a component's id unless it has no other. An empty table gives an empty one; other columns are not read.

    The similarity is that of the whole texts' five-word shingles by count and inverse document frequency over all rows. Buckets miss a link of
    0.8 with probability 0.002; every pair in a bucket is compared unless links already connect it.
    """
    weights = document_frequencies(docs, text_col) if weights is None else weights
    rows = cut_lineage(signatures(docs, weights, id_col, text_col), "signatures")
    classes = rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("copy_id"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies"))
    nodes = cut_lineage(classes.withColumn("node", F.monotonically_increasing_id()), "texts")
    exploded = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = exploded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    members = cut_lineage(exploded.join(shared, "bucket"), "buckets")
    wanted = members.select("node").distinct().join(nodes.select("node", "key", "copy_id"), "node")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("key", text_key())
    texts = source.join(wanted, (source["key"] == wanted["key"]) & source["doc_id"].eqNullSafe(wanted["copy_id"])).select("node", "text")
    texts = cut_lineage(texts, "candidate-texts")
    if texts.count() > texts.select("node").distinct().count():
        texts = cut_lineage(texts.dropDuplicates(["node"]), "candidate-texts")  # a row of the table is repeated
    links = cut_lineage(_links(members, texts, weights, least), "links")
    roots = connected_components(links)
    rooted = cut_lineage(nodes.select("node", "key", "copy_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    # The document that stays: the smallest id, and of equal ids the smallest text hash.
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("copy_id").isNull().alias("none"), F.col("copy_id").alias("id"), F.col("key").alias("key"))).alias("best"))
    of_text = rooted.join(best, "root").select(F.col("key").alias("k"), "copy_id", F.col("best.id").alias("component_id"), F.col("best.key").alias("best_key"))
    joined = rows.select("doc_id", "key").join(of_text, F.col("key") == F.col("k"), "left")
    lone = F.col("k").isNull()
    return joined.select(
        "doc_id",
        "key",
        F.when(lone, F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.when(lone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        (lone | (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("key") == F.col("best_key")))).alias("kept"),
    )
