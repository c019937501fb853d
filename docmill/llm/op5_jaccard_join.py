"""N-gram Jaccard join by rare-first prefix filtering.

A document is its set of distinct word n-grams. Tokens get a global order, rarest
first, from document frequencies counted over all documents in a table of fixed
size. Two sets at or above the threshold share one of their first
``n - ceil(t n) + 1`` tokens, so documents meet on those alone; the sizes (length),
the places of the shared token (positional) and the counts of tokens in fixed ranges
(suffix filter) rule most pairs out; the rest are counted exactly, once per pair.

Documents with equal sets are one class. Links matter only through the components,
so classes meet in rounds: first each meets the hub it shares the most tokens with,
a hub being the class of a token's run with the most shared tokens (the text that
near copies were made from has no tokens of its own); then each component the hub
of its tokens' largest component; at last, exhaustively, all pairs that share a
token but aren't connected. Groups of near copies collapse before that and leave
few pairs; every link between different components is still checked. Rows are
range-partitioned by token, size and class, so a token in a third of all sets
spreads over many partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from docmill.llm.common import components, store
from docmill.llm.op9_suffix_dedup import BASE, _powers, mixed

WORDS, PERCENT = 3, 90
BUCKET_BITS, SLICES, RANGES = 16, 64, 128
PIECE = 1 << 20
BLOCK = 1024      # rows of one token that are compared in one place
PER_TASK = 512    # pairs of one class that are verified in one place


class Shingler:
    """64-bit fingerprints of a text's distinct word n-grams."""

    def __init__(self, words: int):
        self.words, self.limit = words, 0
        fold = np.arange(256, dtype=np.uint8)
        fold[65:91] += 32
        self.values = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)[fold] | np.uint64(1)
        self.blank = np.zeros(256, bool)
        self.blank[[32, *range(9, 14)]] = True

    def word_hashes(self, data: np.ndarray) -> np.ndarray:
        if len(data) > self.limit:
            self.limit = 2 * len(data)
            self.up, self.down = _powers(BASE, self.limit), _powers(pow(BASE, -1, 1 << 64), self.limit)
        inside = ~self.blank[data]
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(start):
            return np.zeros(0, np.uint64)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[:len(data)], out=sums[1:])
        return mixed((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def tokens(self, text: bytes | memoryview) -> np.ndarray:
        """Sorted distinct fingerprints; with fewer words than n, one of the whole sequence."""
        data = np.frombuffer(text, np.uint8)
        parts, at = [], 0
        while at < len(data):     # pieces end at blanks, which bounds memory on long texts
            end = min(at + PIECE, len(data))
            while end < len(data) and not self.blank[data[end]]:
                end += 1
            parts.append(self.word_hashes(data[at:end]))
            at = end
        hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        n = min(self.words, len(hashes))
        if not n:
            return hashes
        out = np.full(len(hashes) - n + 1, n, np.uint64)
        for k in range(n):
            out = mixed(out * np.uint64(BASE) + hashes[k:len(hashes) - n + 1 + k])
        return np.unique(out)


def _frequencies(words: int):
    """Document frequencies of all tokens of a partition, in slices of one table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counts = Shingler(words), np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    np.add.at(counts, (shingler.tokens(text.as_buffer()) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(SLICES), pa.int32()), pa.array([c.tobytes() for c in np.split(counts, SLICES)], pa.binary())],
            names=["slice", "counts"])
    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for key, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total[key] = total.get(key, 0) + np.frombuffer(counts, np.int64)
    if total:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([c.tobytes() for c in total.values()], pa.binary())],
            names=["slice", "counts"])


def bucket_ranks(docs: DataFrame, words: int) -> np.ndarray:
    """Rank of each bucket of tokens by document frequency; the table's size is fixed."""
    kinds = "slice int, counts binary"
    # slices meet in several places before the last one, however many tasks there were
    parts = docs.select("text").mapInArrow(_frequencies(words), kinds)
    rows = (parts.repartition("slice").mapInArrow(_added, kinds)).collect()
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    width = len(counts) // SLICES
    for r in rows:
        counts[r.slice * width:(r.slice + 1) * width] += np.frombuffer(r.counts, np.int64)
    ranks = np.empty(len(counts), np.uint64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.uint64)
    return ranks


def ordered(tokens: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Tokens renamed so that their order is rarest first; a one-to-one map."""
    low = np.uint64(64 - BUCKET_BITS)
    return np.sort(ranks[(tokens >> low).astype(np.int64)] << low | tokens & np.uint64((1 << 64 - BUCKET_BITS) - 1))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _sets(words: int, percent: int, ranks: np.ndarray):
    """``doc_id, text`` to set size, class, prefix and counts per token range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            size, cls, prefix, ends, ranges = [], [], [], [0], []
            for text in batch.column(1):
                tokens = ordered(shingler.tokens(text.as_buffer()), ranks)
                n = len(tokens)
                own = tokens[:prefix_length(n, percent)] if n else tokens
                size.append(n)
                cls.append(int(mixed(mixed(tokens).sum(keepdims=True) ^ np.uint64(n)).view(np.int64)[0]) if n else None)
                prefix.append(own)
                ends.append(ends[-1] + len(own))
                spread = np.bincount((tokens & np.uint64(RANGES - 1)).astype(np.int64), minlength=RANGES)
                ranges.append(np.minimum(spread, 32767).astype(np.int16))
            flat = np.concatenate(prefix) if prefix else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(size, pa.int64()), pa.array(cls, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(flat.view(np.int64))),
                 pa.array(ranges, pa.list_(pa.int16()))],
                names=["doc_id", "twin", "n", "class", "prefix", "ranges"])
    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one token range whose token another set has, and the two at the edges."""
    rows = pa.Table.from_batches(b) if (b := list(batches)) else None
    if rows is None or not rows.num_rows:
        return
    order = np.argsort(rows.column("token").to_numpy(), kind="stable")
    token = rows.column("token").to_numpy()[order]
    equal = np.concatenate([[True], token[1:] == token[:-1], [True]])
    yield from rows.take(pa.array(order[equal[:-1] | equal[1:]])).combine_chunks().to_batches(max_chunksize=1 << 16)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = pa.array([pack.compress(t.as_buffer()) for t in batch.column(2)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], names=["doc_id", "twin", "packed"])


def _verify(words: int, percent: int):
    """Sorted rows ``a, salt, b, packed``: the row with a null ``b`` holds a's own text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, unpack = Shingler(words), zstandard.ZstdDecompressor()
        now, own = None, None
        for batch in batches:
            links = []
            for a, b, packed in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                tokens = shingler.tokens(unpack.decompress(packed.as_py()))
                if b is None:
                    now, own = a, tokens
                elif now == a:
                    both = len(np.intersect1d(own, tokens, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(tokens) - both):
                        links.append((a, b))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])
    return run


def _block_pairs(percent: int):
    """Runs of rows sorted by ``token, low, high``: pairs that pass all filters."""
    def filtered(rows: dict, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, at, part = rows["n"], rows["at"], rows["part"]
        total = n[a] + n[b]
        most = np.minimum(at[a], at[b]) + 1 + np.minimum(n[a] - at[a], n[b] - at[b]) - 1
        keep = (part[a] != part[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])) \
            & ((100 + percent) * most >= percent * total)
        a, b, total = a[keep], b[keep], total[keep]
        out = np.zeros(len(a), bool)
        for k in range(0, len(a), 1 << 14):
            x, y = rows["ranges"][a[k:k + (1 << 14)]], rows["ranges"][b[k:k + (1 << 14)]]
            apart = np.abs(x - y).sum(axis=1, dtype=np.int64)
            some = total[k:k + (1 << 14)]
            out[k:k + (1 << 14)] = (100 + percent) * (some - apart) >= 2 * percent * some
        return a[out], b[out]

    def pairs_of(table: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = {c: table.column(c).to_numpy() for c in ("token", "low", "high", "block", "class", "n", "at", "part")}
        rows["ranges"] = table.column("ranges").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        change = np.zeros(table.num_rows, bool)
        for c in ("token", "low", "high"):
            change[1:] |= rows[c][1:] != rows[c][:-1]
        change[0] = True
        start = np.flatnonzero(change)
        left, right, held = [], [], 0
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for s, e in zip(start.tolist(), np.append(start[1:], table.num_rows).tolist()):
            low, high = rows["low"][s], rows["high"][s]
            if low == high:
                a, b = np.triu_indices(e - s, 1)
                left.append(a + s)
                right.append(b + s)
            else:
                one, two = s + np.flatnonzero(rows["block"][s:e] == low), s + np.flatnonzero(rows["block"][s:e] == high)
                left.append(np.repeat(one, len(two)))
                right.append(np.tile(two, len(one)))
            held += len(left[-1])
            if held > 1 << 18:
                found.append(filtered(rows, np.concatenate(left), np.concatenate(right)))
                left, right, held = [], [], 0
        if left:
            found.append(filtered(rows, np.concatenate(left), np.concatenate(right)))
        a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int),) * 2
        one, two = rows["class"][a], rows["class"][b]
        if len(one):
            both = np.unique(np.stack([np.minimum(one, two), np.maximum(one, two)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < 1 << 13:
                continue
            table = pa.Table.from_batches(held)
            keys = [table.column(c).to_numpy() for c in ("token", "low", "high")]
            last = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))
            if len(last):      # the last run may go on
                yield from pairs_of(table.slice(0, int(last[-1]) + 1))
                table = table.slice(int(last[-1]) + 1)
            held = table.to_batches()
        if held:
            yield from pairs_of(pa.Table.from_batches(held))
    return run


def _apart(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of one token in different parts, by blocks against blocks.

    Rows outside the token's largest part meet each other and all rows of it; a
    token with more than ``BLOCK`` rows on a side takes several pairs of blocks.
    """
    minor = F.col("part") != F.col("main")
    sizes = rows.groupBy("token").agg(
        F.greatest(F.lit(1), F.ceil(F.count(F.when(minor, 1)) / BLOCK)).cast("int").alias("minors"),
        F.greatest(F.lit(1), F.ceil(F.count(F.when(~minor, 1)) / BLOCK)).cast("int").alias("majors"))
    dealt = rows.join(sizes, "token").join(classes.select("class", "ranges"), "class").withColumn(
        "block", F.expr("cast(if(part <> main, pmod(xxhash64(class), minors), minors + pmod(xxhash64(class), majors)) as int)"))
    # a block of the largest part meets the others' blocks; those meet all blocks
    other = F.expr("if(part <> main, sequence(0, minors + majors - 1), sequence(0, minors - 1))")
    return dealt.withColumn("other", F.explode(other)).select(
        "token", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block",
        "class", "n", "at", "part", "ranges",
    ).repartition("token", "low", "high").sortWithinPartitions("token", "low", "high").mapInArrow(
        _block_pairs(percent), "a long, b long")


def _linked(pairs: DataFrame, texts: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the distinct pairs ``a, b`` of classes that reach the threshold."""
    # suffix filter: what token ranges differ by bounds the symmetric difference
    size = sets.select("class", "n", "ranges")
    for side in ("a", "b"):
        pairs = pairs.join(size.select(F.col("class").alias(side), F.col("n").alias(f"n_{side}"),
                                       F.col("ranges").alias(f"r_{side}")), side)
    apart = F.aggregate(F.zip_with("r_a", "r_b", lambda x, y: F.abs(x.cast('int') - y.cast('int'))), F.lit(0), lambda s, x: s + x)
    total = F.col("n_a") + F.col("n_b")
    # |A and B| = (total - difference) / 2, and a link needs 100 |and| >= percent (total - |and|)
    pairs = pairs.where((100 + percent) * (total - apart) >= 2 * percent * total).select("a", "b")
    tasks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PER_TASK).cast("int").alias("parts"))
    others = pairs.join(tasks, "a").join(texts.withColumnRenamed("class", "b"), "b").select(
        "a", F.expr("cast(pmod(xxhash64(b), parts) as int)").alias("salt"), "b", "packed")
    own = tasks.select("a", F.explode(F.expr("sequence(0, parts - 1)")).alias("salt")).join(
        texts.withColumnRenamed("class", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "packed")
    dealt = own.union(others).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return store(dealt.mapInArrow(_verify(words, percent), "a long, b long"), "set-links")


def _reach(n1: str, p1: str, n2: str, p2: str, percent: int) -> str:
    """Length and positional filters, for sets of sizes n with a shared token at places p."""
    return (f"100 * least({n1}, {n2}) >= {percent} * greatest({n1}, {n2}) and {100 + percent} * "
            f"(least({p1}, {p2}) + 1 + least({n1} - {p1}, {n2} - {p2}) - 1) >= {percent} * ({n1} + {n2})")


def _closest(met: DataFrame, key: str) -> DataFrame:
    """Per ``key`` the class and hub that share the most tokens."""
    return met.groupBy(*{key, "class"}, F.col("hub.class").alias("other")).agg(F.count(F.lit(1)).alias("k")) \
        .groupBy(key).agg(F.max(F.struct("k", F.col("class").alias("one"), "other")).alias("best"))


def _pairs(closest: DataFrame) -> DataFrame:
    return closest.select(F.least("best.one", "best.other").alias("a"),
                          F.greatest("best.one", "best.other").alias("b")).distinct()


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, twin``, one row per row of ``docs``.

    Documents link when ``100 |A and B| >= percent |A or B|`` for their sets;
    ``component_id`` is the smallest ``doc_id`` reachable by links. Words are cut at
    ASCII blanks, A-Z folded. Null, empty and blank texts have no n-grams and link
    with nothing. Rows that repeat an id are documents of their own; null ids link
    but name no component. ``twin`` is a hash of the text. Other columns are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.cast("binary").alias("text"), F.xxhash64(text).alias("twin"))
    ranks = bucket_ranks(rows, words)
    sets = store(rows.mapInArrow(
        _sets(words, percent, ranks),
        f"doc_id {kind}, twin long, n long, class long, prefix array<long>, ranges array<short>"), "sets")
    full = sets.where("n > 0")
    classes = store(full.groupBy("class").agg(
        F.min("doc_id").alias("first"), F.max("n").alias("n"), F.any_value("ranges").alias("ranges"),
        F.min(F.struct("doc_id", "twin")).alias("home")), "set-classes")

    spread = full.select("class", "n", "prefix").dropDuplicates(["class"]).select(
        "class", "n", F.posexplode("prefix").alias("at", "token"))
    met = store(
        spread.select("token", "n", "class", F.col("at").cast("long").alias("at"))
        .repartitionByRange("token", "n", "class").mapInArrow(
            _shared, "token long, n long, class long, at long"), "shared-tokens")
    # the text that others were copied from has no tokens of its own
    shared = store(met.join(met.groupBy("class").agg(F.count(F.lit(1)).alias("ties")), "class"), "tied-tokens")
    hub = F.max(F.struct("ties", (-F.col("n")).alias("short"), "class", "at", "n")).alias("hub")
    reach = _reach("n", "at", "hub.n", "hub.at", percent)
    hubs = store(shared.groupBy("token").agg(hub), "hubs")
    tried = store(_pairs(_closest(shared.join(hubs, "token").where(f"class <> hub.class and {reach}"), "class")),
                  "hub-pairs")

    packed = rows.select("doc_id", "twin", "text").mapInArrow(_pack, f"doc_id {kind}, twin long, packed binary")
    homes = classes.join(shared.select("class").distinct(), "class").select(
        "class", F.col("home.doc_id").alias("id_"), F.col("home.twin").alias("twin_"))
    texts = packed.join(homes, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("twin") == F.col("twin_"))) \
        .select("class", "packed")
    if not sets.groupBy("doc_id", "twin").count().where("count > 1").isEmpty():
        texts = texts.dropDuplicates(["class"])
    texts = store(texts, "set-texts")

    links = _linked(tried, texts, classes, words, percent)
    for last in (False, True):
        named = components(links)
        placed = store(shared.join(named, F.col("class") == F.col("node"), "left").select(
            "token", "n", "class", "at", "ties", F.coalesce("component", "class").alias("part")), "placed-tokens")
        parts = placed.groupBy("token", "part").agg(F.count(F.lit(1)).alias("count"), hub)
        split = parts.groupBy("token").agg(
            F.max(F.struct("count", "part", "hub")).alias("top"), F.count(F.lit(1)).alias("parts")
        ).where("parts > 1").select("token", F.col("top.part").alias("main"), F.col("top.hub").alias("hub"))
        apart = placed.join(split, "token")
        if last:     # all pairs that aren't connected
            pairs = _apart(apart.drop("hub", "ties"), classes, percent)
        else:        # one for each component, with the hub of the token's largest
            pairs = _pairs(_closest(apart.where(f"part <> main and {reach}"), "part"))
        rest = store(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "more-pairs")
        tried = tried.union(rest)
        links = links.union(_linked(rest, texts, classes, words, percent))

    named = components(links)
    labeled = classes.select("class", "first").join(named, F.col("class") == F.col("node"), "left").select(
        "class", "first", F.coalesce("component", "class").alias("part"))
    smallest = labeled.groupBy("part").agg(F.min("first").alias("component_id"))
    by_class = labeled.join(smallest, "part").select(F.col("class").alias("class_"), "component_id")
    return sets.join(by_class, F.col("class") == F.col("class_"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "twin")
