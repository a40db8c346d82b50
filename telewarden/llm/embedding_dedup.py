"""Near-duplicate vectors by tiled comparison along principal axes.

Equal vectors form one class. The axes come from the second moments of all unit vectors, added up by Spark. Classes are cut into
chunks along the first axis and chunks within reach of the threshold meet as tiles. A tile adds up products of the leading axes,
bounds the rest by the product of suffix norms, and drops a pair as soon as its cosine cannot reach the threshold; what is left is decided
in double precision on the vectors as given. A tile returns counts of links and a spanning forest of them, never
pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telewarden.llm.components import connected_components
from telewarden.session import cut_lineage

#: Most vectors of a chunk, and the number of chunks aimed at while they are smaller than that.
CHUNK_ROWS, LEAST_CHUNK_ROWS, CHUNKS = 16_384, 1_024, 12
#: Most bytes of a chunk's vectors, and links a tile holds before they are folded into its classes.
CHUNK_BYTES, LINKS_HELD = 64 << 20, 1 << 20
#: Rows and columns of the part of a tile that is compared at once.
PART_ROWS = 1_024
#: Leading axes that are added up before pairs are dropped, in turn.
AXES = (8, 16, 32)
#: Candidates gathered at once, and slack for products in single precision.
GATHERED, SLACK = 1 << 16, 1e-4
_PACKED = "chunk int, nodes binary, copies binary, vectors binary, width int"


def classes_of(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the hash of their vector, null where it takes no part, and one row per class of equal vectors."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    live = v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    # A negative zero equals zero, but not for the hash.
    plain = F.when(live, F.transform(v, lambda x: x.cast("double") + F.lit(0.0)))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), plain.alias("v"))
    keyed = rows.withColumns({"k1": F.when(F.col("v").isNotNull(), F.xxhash64("v")), "k2": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v"))})
    classes = keyed.where("v is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    stored = cut_lineage(classes.withColumns({"node": F.monotonically_increasing_id(), "width": F.size("v")}), "vector-classes")
    return keyed.drop("v"), stored


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return np.asarray(pa.compute.list_flatten(column), np.float64).reshape(rows, -1)


def principal_axes(classes: DataFrame, width: int) -> np.ndarray:
    """Axes of all unit vectors of one length as columns, by falling second moment; ``width ** 2`` sums reach the driver."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                unit = _unit(_matrix(batch.column("v"), batch.num_rows))
                total += unit.T @ unit
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total.reshape(-1)[at])], ["at", "s"])

    sums = classes.where(F.col("width") == width).select("v").mapInArrow(moments, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()
    total = np.zeros(width * width)
    for row in sums:
        total[row["at"]] = row["s"]
    return np.linalg.eigh(total.reshape(width, width))[1][:, ::-1].copy()


def linked_pairs(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places ``i, j`` of linked rows of ``a`` and ``b``, given as unit vectors (``pa_, pb``: along the axes, single precision)."""
    axes = [n for n in AXES if n < a.shape[1]] or [a.shape[1]]
    rest_a = {n: np.sqrt((pa_[:, n:].astype(float) ** 2).sum(axis=1)).astype(np.float32) for n in axes}
    rest_b = {n: np.sqrt((pb[:, n:].astype(float) ** 2).sum(axis=1)).astype(np.float32) for n in axes}
    first = axes[0]
    for x in range(0, len(a), PART_ROWS):
        for y in range(0, len(b), PART_ROWS):
            head = pa_[x : x + PART_ROWS, :first] @ pb[y : y + PART_ROWS, :first].T
            bound = head + rest_a[first][x : x + PART_ROWS, None] * rest_b[first][None, y : y + PART_ROWS]
            rows, cols = np.nonzero(bound >= threshold - SLACK)
            for k in range(0, len(rows), GATHERED):
                i, j = rows[k : k + GATHERED], cols[k : k + GATHERED]
                sums, done = head[i, j], first
                i, j = i + x, j + y
                for n in axes[1:]:
                    sums = sums + np.einsum("ij,ij->i", pa_[i, done:n], pb[j, done:n])
                    can = sums + rest_a[n][i] * rest_b[n][j] >= threshold - SLACK
                    i, j, sums, done = i[can], j[can], sums[can], n
                exact = np.einsum("ij,ij->i", a[i], b[j]) >= threshold
                if exact.any():
                    yield i[exact], j[exact]


def _forest(n: int, links: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of ``n`` nodes the smallest one reachable over ``links``."""
    label = np.arange(n)
    while True:
        before = label.copy()
        for i, j in links:
            low = np.minimum(label[i], label[j])
            np.minimum.at(label, label[i], low)
            np.minimum.at(label, label[j], low)
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def near_duplicates(df: DataFrame, threshold: float = 0.9, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``df``; a link is a cosine of at least ``threshold``.

    ``n_links`` counts other rows, repeated ones too; ``component_id`` is the smallest id reachable, the own included. A vector that is null, zero, or
    holds a null or non-finite component links with nothing, nor do vectors of different lengths. A row without an
    id is kept unless its component has an id. An empty table gives an empty one; other columns are not read.

    All pairs of chunks within reach meet, by the method; each class is sent once per chunk it meets. Chunks grow up to a
    fixed size, so a task's memory is bounded. A common vector is one class.
    """
    keyed, classes = classes_of(df, id_col, vector_col)
    widths = {r["width"]: r["n"] for r in classes.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()}
    main = max(widths, key=lambda w: (widths[w], -w), default=0)
    axes = principal_axes(classes, main) if main else np.zeros((0, 0))
    widest = max(widths, default=1)
    rows_per_chunk = min(CHUNK_ROWS, max(1, CHUNK_BYTES // (8 * max(widest, 1))), max(LEAST_CHUNK_ROWS, -(-sum(widths.values()) // CHUNKS)))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, width = np.zeros(batch.num_rows), batch.column("width").to_numpy()
            at = np.flatnonzero(width == main)
            if len(at):
                z[at] = _unit(_matrix(batch.column("v").take(pa.array(at)), len(at))) @ axes[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(z)], [*batch.schema.names, "z"])

    placed = classes.select("node", "copies", "v", "width").mapInArrow(project, "node long, copies long, v array<double>, width int, z double")
    placed = cut_lineage(placed, "projected")
    # Ranges along the first axis, all of one length; a range that ties make too large is split by hash.
    cuts = -(-widths.get(main, 0) // rows_per_chunk)
    edges = np.zeros(0)
    if cuts > 1:
        shares = [i / cuts for i in range(1, cuts)]
        edges = np.unique(placed.where(F.col("width") == main).agg(F.percentile_approx("z", F.array(*map(F.lit, shares)), 10 * cuts)).first()[0])
    bounds = F.array(*[F.lit(float(e)) for e in edges]) if len(edges) else F.array().cast("array<double>")
    range_ = F.when(F.col("width") == main, F.size(F.filter(bounds, lambda e: e <= F.col("z")))).otherwise(0)
    ranged = placed.withColumn("range", range_)
    sizes = ranged.groupBy("width", "range").agg(F.count(F.lit(1)).alias("n"), F.min("z").alias("low"), F.max("z").alias("high")).orderBy("width", "range").collect()
    chunks, rows = [], []  # chunk: its length, and how far its first coordinates go
    for r in sizes:
        splits = -(-r["n"] // rows_per_chunk)
        rows.append((r["width"], r["range"], splits, len(chunks)))
        chunks += [(r["width"], r["low"], r["high"])] * splits
    # Unit vectors whose cosine is at least the threshold differ by no more than this in any coordinate.
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9
    partners = []
    last = 0
    for k, (width, _, high) in enumerate(chunks):
        last = max(last, k)
        while last + 1 < len(chunks) and chunks[last + 1][0] == width and chunks[last + 1][1] <= high + reach:
            last += 1
        partners.append(last)
    firsts = [int(np.searchsorted(partners[: k + 1], k)) for k in range(len(chunks))]
    spark = df.sparkSession
    split_table = spark.createDataFrame(rows, "width int, range int, splits int, base int")
    meets = spark.createDataFrame([(k, f, p) for k, (f, p) in enumerate(zip(firsts, partners, strict=True))], "chunk int, lowest int, highest int")

    def pack(table: pa.Table) -> pa.Table:
        row = [
            table.column("chunk")[0].as_py(), table.column("node").to_numpy().tobytes(), table.column("copies").to_numpy().tobytes(),
            _matrix(table.column("v").combine_chunks(), table.num_rows).tobytes(), table.column("width")[0].as_py(),
        ]
        types = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32()]
        return pa.Table.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], ["chunk", "nodes", "copies", "vectors", "width"])

    chunked = ranged.join(F.broadcast(split_table), ["width", "range"])
    chunked = chunked.withColumn("chunk", (F.col("base") + F.pmod(F.xxhash64("node"), F.col("splits"))).cast("int"))
    packed = chunked.select("chunk", "node", "copies", "v", "width").groupBy("chunk").applyInArrow(pack, _PACKED).join(F.broadcast(meets), "chunk")
    partner = packed.withColumn("other", F.explode(F.sequence("lowest", "highest")))
    tiles = partner.withColumns({"a": F.least("chunk", "other"), "b": F.greatest("chunk", "other")}).drop("lowest", "highest", "other")

    def compare(table: pa.Table) -> pa.Table:
        sides = []
        for row in sorted(table.to_pylist(), key=lambda r: r["chunk"]):
            unit = _unit(np.frombuffer(row["vectors"], np.float64).reshape(-1, row["width"]))
            along = (unit @ axes if row["width"] == main else unit).astype(np.float32)
            sides.append((np.frombuffer(row["nodes"], np.int64), np.frombuffer(row["copies"], np.int64), unit, along))
        one, two = sides[0], sides[-1]
        itself = len(sides) == 1
        shift = 0 if itself else len(one[0])
        nodes = one[0] if itself else np.concatenate([one[0], two[0]])
        copies = one[1] if itself else np.concatenate([one[1], two[1]])
        counts, links, held = np.zeros(len(nodes), np.int64), [], 0
        for i, j in linked_pairs(one[2], two[2], one[3], two[3], threshold):
            if itself:
                other = i < j
                i, j = i[other], j[other]
            j = j + shift
            np.add.at(counts, i, copies[j])
            np.add.at(counts, j, copies[i])
            links.append((i.astype(np.int32), j.astype(np.int32)))
            held += len(i)
            if held > LINKS_HELD:  # what is connected so far is a link of each node to its root
                links, held = [(np.arange(len(nodes), dtype=np.int32), _forest(len(nodes), links).astype(np.int32))], 0
        root = _forest(len(nodes), links)
        linked = np.flatnonzero(counts)
        arrays = [pa.array(nodes[linked]), pa.array(nodes[root[linked]]), pa.array(counts[linked])]
        return pa.Table.from_arrays(arrays, ["node", "root", "links"])

    found = cut_lineage(tiles.groupBy("a", "b").applyInArrow(compare, "node long, root long, links long"), "tiles")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    joined = classes.select("node", "k1", "k2", "first_id", "copies").join(links, "node", "left").join(roots, "node", "left")
    joined = cut_lineage(joined.withColumn("root", F.coalesce("root", "node")), "linked-classes")
    smallest = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_class = joined.join(smallest, "root").select(
        F.col("k1").alias("c1"), F.col("k2").alias("c2"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    out = keyed.join(of_class, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    component = F.when(F.col("c1").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id"))
    )
