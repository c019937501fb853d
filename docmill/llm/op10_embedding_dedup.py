"""Embedding near-dedup with a random-projection tree forest.

Every tree splits the unit vectors by random directions, level after level, at the
median of a sample; a vector within ``SPILL`` of the threshold goes to both sides,
so that a close pair is parted only if its projections differ by more than twice
that. Vectors meet in the leaves, every pair of a leaf is compared exactly, and the
links are united. A pair that meets in several leaves counts in the first one: rows
carry all their leaves. Leaves report a count and one root per vector, never pairs.

Equal vectors are one class. A leaf with more than ``BLOCK`` classes is compared in
blocks against blocks, each pair of blocks in a task of its own, so a tight cluster
of any size stays exact in bounded memory. The forest is fitted on at most
``SAMPLE`` vectors; below the depth a sample supports, thresholds are zero, which
costs balance, not links. All vectors are indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docmill.llm.common import components, store

THRESHOLD = 0.95
TREES, LEAF_ROWS, SPILL = 4, 256, 0.02
SAMPLE, SUPPORT = 16_384, 32   # vectors to fit on; sample points a median needs
BLOCK = 2048


def directions(dim: int, depth: int, trees: int = TREES) -> np.ndarray:
    """Unit directions per tree and level, the same for every task."""
    d = np.random.default_rng([11, dim]).normal(size=(depth, trees, dim))
    return d / np.maximum(np.linalg.norm(d, axis=2, keepdims=True), 1e-300)


def fit(sample: np.ndarray, depth: int, trees: int = TREES) -> list[list[dict[int, float]]]:
    """Per tree and level: median threshold of the nodes that the sample supports."""
    out: list[list[dict[int, float]]] = [[{} for _ in range(depth)] for _ in range(trees)]
    ways = directions(sample.shape[1], depth, trees)
    for t in range(trees):
        node = np.zeros(len(sample), np.int64)
        for level in range(depth):
            seen = sample @ ways[level, t]
            order = np.lexsort((seen, node))
            codes, first, count = np.unique(node[order], return_index=True, return_counts=True)
            middle = seen[order][first + count // 2]
            for code, m, c in zip(codes.tolist(), middle.tolist(), count.tolist()):
                if c >= SUPPORT:
                    out[t][level][code] = m
            cut = np.array([out[t][level].get(c, 0.0) for c in codes])[np.searchsorted(codes, node)]
            node = node * 2 + (seen >= cut)
    return out


def leaves(unit: np.ndarray, cuts, depth: int, spill: float = SPILL) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per tree the rows and their leaf codes; a row may have several."""
    trees = len(cuts)
    ways = directions(unit.shape[1], depth, trees)
    for t in range(trees):
        row, node = np.arange(len(unit)), np.zeros(len(unit), np.int64)
        for level in range(depth):
            seen = (unit @ ways[level, t])[row]
            codes, place = np.unique(node, return_inverse=True)
            cut = np.array([cuts[t][level].get(c, 0.0) for c in codes.tolist()])[place] if len(codes) else np.zeros(0)
            left, right = seen < cut + spill, seen >= cut - spill
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([node[left] * 2, node[right] * 2 + 1])
        yield row, node


def vectors(column: pa.Array) -> np.ndarray:
    """A column of equally long vectors as doubles of unit length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    # scaled first, so that squares neither overflow nor vanish
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def _assign(models: dict[int, list], depth: int):
    """``class, n, embedding`` to one row per leaf, with all leaves of the class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes).tolist():
                part = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                unit = vectors(part.column(2))
                row, leaf = (np.concatenate(x) for x in zip(*(
                    (r, (node << 3 | t)) for t, (r, node) in enumerate(leaves(unit, models[dim], depth)))))
                order = np.argsort(row, kind="stable")
                row, leaf = row[order], leaf[order]
                ends = np.searchsorted(row, np.arange(len(unit) + 1))
                own = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(leaf))
                for start in range(0, len(row), 1 << 14):
                    take = pa.array(row[start:start + (1 << 14)])
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(i).take(take) for i in range(3)), own.take(take),
                         pa.array(np.full(len(take), dim, np.int64)), pa.array(leaf[start:start + (1 << 14)])],
                        names=["class", "n", "embedding", "leaves", "dim", "leaf"])
    return run


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable by the links, by label spreading and jumping."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _link(threshold: float):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        leaf, first, second = (k.as_py() for k in key[1:4])
        cls, n, block = (table.column(c).to_numpy() for c in ("class", "n", "block"))
        unit = vectors(table.column("embedding"))
        own = table.column("leaves").combine_chunks()
        width = int(own.value_lengths().to_numpy().max())
        grid = np.full((len(cls), width), -1, np.int64)
        lengths = own.value_lengths().to_numpy()
        grid[np.repeat(np.arange(len(cls)), lengths), np.concatenate([np.arange(k) for k in lengths])] = own.flatten().to_numpy()
        here = (grid == leaf).argmax(axis=1)
        grid[np.arange(width)[None, :] >= here[:, None]] = -1   # earlier leaves only
        left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
        links = []
        for start in range(0, len(left), 512):
            some = left[start:start + 512]
            a, b = np.nonzero(unit[some] @ unit[right].T >= threshold)
            a, b = some[a], right[b]
            keep = (a < b) if first == second else np.ones(len(a), bool)
            links.append((a[keep], b[keep]))
        a, b = (np.concatenate(x) for x in zip(*links)) if links else (np.zeros(0, int), np.zeros(0, int))
        met = np.zeros(len(a), bool)
        for k in range(width):
            column = grid[a, k]
            met |= ((grid[b] == column[:, None]) & (column >= 0)[:, None]).any(axis=1)
        fresh_a, fresh_b = a[~met], b[~met]
        count = np.zeros(len(cls), np.int64)
        np.add.at(count, fresh_a, n[fresh_b])
        np.add.at(count, fresh_b, n[fresh_a])
        order = np.argsort(cls)                                  # roots by smallest class
        rank = np.argsort(order)
        root = cls[order][_roots(len(cls), rank[a], rank[b])[rank]]
        said = np.flatnonzero((count > 0) | (root != cls))
        return pa.table({"class": cls[said], "n_links": count[said], "root": root[said]})
    return run


def embedding_dedup(rows: DataFrame, threshold: float = THRESHOLD, leaf_rows: int = LEAF_ROWS,
                    block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per row of ``rows``.

    ``rows``: ``vec_id, embedding``; other columns, labels too, are ignored. Vectors
    that are null, empty, zero or hold null or non-finite components link with
    nothing; vectors of different length never link. Rows with one ``vec_id`` are
    vectors of their own; a null id has no say in a component's smallest id.
    """
    spark = rows.sparkSession
    item = F.col("embedding")
    sound = item.isNotNull() & (F.size(item) > 0) & F.forall(
        item, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(item, lambda x: x != 0)
    rows = rows.select("vec_id", F.when(sound, item).alias("embedding"))
    classes = store(
        rows.where("embedding is not null").groupBy("embedding")
        .agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .withColumn("class", F.monotonically_increasing_id()), "vector-classes")
    depth, models = 0, {}
    total = classes.count()
    while total > leaf_rows << depth and depth < 56:
        depth += 1
    sample = classes.orderBy(F.xxhash64("class"), "class").select("embedding").limit(SAMPLE).toArrow()
    sizes = sample.column(0).combine_chunks().value_lengths().to_numpy() if sample.num_rows else np.zeros(0, int)
    for r in classes.select(F.size("embedding").alias("dim")).distinct().collect():
        part = sample.filter(pa.array(sizes == r.dim))
        unit = vectors(part.column(0)) if part.num_rows else np.zeros((0, r.dim))
        models[r.dim] = fit(unit, depth)

    kind = dict(classes.dtypes)["embedding"]
    placed = classes.select("class", "n", "embedding").repartition(
        spark.sparkContext.defaultParallelism).mapInArrow(
        _assign(models, depth),
        f"class long, n long, embedding {kind}, leaves array<long>, dim long, leaf long")
    placed = store(placed, "leaves")
    full = placed.groupBy("dim", "leaf").count().where(F.col("count") > 1).select(
        "dim", "leaf", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    dealt = placed.join(full, ["dim", "leaf"]).withColumn("block", F.expr("cast(pmod(xxhash64(class), blocks) as int)"))
    pairs = dealt.select("*", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other")).select(
        "class", "n", "embedding", "leaves", "dim", "leaf", "block",
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    linked = store(pairs.groupBy("dim", "leaf", "low", "high").applyInArrow(
        _link(threshold), "class long, n_links long, root long"), "vector-links")

    counts = linked.groupBy("class").agg(F.sum("n_links").alias("n_links"))
    roots = components(linked.select(F.col("class").alias("a"), F.col("root").alias("b")))
    named = classes.join(roots, F.col("class") == F.col("node"), "left").withColumn(
        "component", F.coalesce("component", "class"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    by_class = named.join(smallest, "component").join(counts, "class", "left").select(
        F.col("embedding").alias("same"), "component_id",
        (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("links"))
    out = rows.join(by_class, F.col("embedding") == F.col("same"), "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("same").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
