"""Suffix-array dedup: remove every byte inside a 200-byte string that occurs twice.

Suffixes are sorted, and neighbours that agree on 200 bytes show a repeat. Sorting
one suffix per byte would move hundreds of bytes for each byte of text, so two
rounds sort far fewer, with the same result:

1. Each window of 200 bytes owns the smallest fingerprint among its 100-byte
   substrings; equal windows own it at the same place. Consecutive windows with the
   same owner form a run. One suffix per run, starting at the owner, is sorted by
   its leading token (the owner's fingerprint), then by the fingerprint of all bytes
   that the run's windows cover. Neighbours equal in both: every window of the run
   repeats. A leading token without an equal neighbour: none does.
2. Where a leading token repeats with different tails, at the edges of repeated
   passages, one run of each tail is opened: its windows are sorted as suffixes of
   their own, by two independent fingerprints of the window.

Both sorts are the same operator: sampled splitters range-partition the suffixes by
their tokens and, among equals, by place, so that a passage in a third of all
documents spans as many partitions as it needs; each partition sorts by multikey
quicksort; and the first and last suffix of every partition are compared across the
boundaries. Texts move twice, compressed, to meet their suffixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from docmill.llm.common import store

LENGTH = 200     # bytes of a repeated string
OWNER = 100      # bytes of the substrings that own windows
SEGMENT = 1 << 18  # window starts handled at once, which bounds memory on long texts
BASE, PRIME, BASE2 = 0x9E3779B97F4A7C15, (1 << 31) - 1, 48271


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (1 << 64) - 1, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _powers_mod(base: int, n: int) -> np.ndarray:
    out, filled, step = np.ones(n, np.uint64), 1, base
    while filled < n:
        k = min(filled, n - filled)
        out[filled:filled + k] = out[:k] * np.uint64(step) % np.uint64(PRIME)
        filled, step = filled + k, step * step % PRIME
    return out


class Hasher:
    """Fingerprints of substrings by differences of prefix sums."""

    def __init__(self, limit: int):
        self.values = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        self.small = self.values % np.uint64(PRIME)
        self.up, self.down = _powers(BASE, limit + 1), _powers(pow(BASE, -1, 1 << 64), limit + 1)
        self.up2, self.down2 = _powers_mod(BASE2, limit + 1), _powers_mod(pow(BASE2, -1, PRIME), limit + 1)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[:len(data)], out=out[1:])
        return out

    def at(self, sums: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        """Fingerprints of ``start:end``; ``sums`` from :meth:`prefix`."""
        return mixed((sums[end] - sums[start]) * self.down[:len(sums)][start])

    def second(self, data: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
        """Independent fingerprints modulo a prime."""
        p, sums = np.uint64(PRIME), np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.small[data] * self.up2[:len(data)] % p, out=sums[1:])
        return (sums[start + length] - sums[start]) % p * self.down2[start] % p


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, from block prefixes and suffixes."""
    n = len(a) - width + 1
    blocks = np.full(-(-len(a) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:len(a)] = a
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def runs(data: np.ndarray, hasher: Hasher) -> Iterator[tuple[np.ndarray, ...]]:
    """``lead, tail, start, n``: owner, covered bytes, first window and number of windows."""
    for base in range(0, max(len(data) - LENGTH + 1, 0), SEGMENT):
        part = data[base:base + SEGMENT + LENGTH - 1]
        sums = hasher.prefix(part)
        grams = hasher.at(sums, slice(0, len(part) - OWNER + 1), slice(OWNER, None))
        # of equals the leftmost: the low bits hold the place
        ranked = grams >> np.uint64(20) << np.uint64(20) | np.arange(len(grams), dtype=np.uint64)
        owner = sliding_min(ranked, LENGTH - OWNER + 1) & np.uint64((1 << 20) - 1)
        start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        end = np.append(start[1:], len(owner))
        tail = hasher.at(sums, start, end - 1 + LENGTH) + (end - start).astype(np.uint64)
        yield grams[owner[start]], tail, start + base, end - start


ROW = "lead long, tail long, doc_id {id}, twin long, start long, n long"


def _batch(schema_names, ids, twins, lead, tail, start, n, owner) -> pa.RecordBatch:
    take = pa.array(owner)
    return pa.RecordBatch.from_arrays(
        [pa.array(lead.view(np.int64)), pa.array(tail.view(np.int64)), ids.take(take), twins.take(take),
         pa.array(start.astype(np.int64)), pa.array(n.astype(np.int64))], names=schema_names)


NAMES = ["lead", "tail", "doc_id", "twin", "start", "n"]


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher(SEGMENT + LENGTH)
    for batch in batches:
        found, held = [], 0
        for k, text in enumerate(batch.column(2)):
            data = np.frombuffer(text.as_buffer(), np.uint8)
            for lead, tail, start, n in runs(data, hasher):
                found.append((lead, tail, start, n, np.full(len(lead), k)))
                held += len(lead)
            if held > 1 << 18:
                yield _batch(NAMES, batch.column(0), batch.column(1), *map(np.concatenate, zip(*found)))
                found, held = [], 0
        if found:
            yield _batch(NAMES, batch.column(0), batch.column(1), *map(np.concatenate, zip(*found)))


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the given runs, one suffix each."""
    hasher, unpack = Hasher(SEGMENT + LENGTH), zstandard.ZstdDecompressor()
    for batch in batches:
        found, held = [], 0
        for k, (packed, pending) in enumerate(zip(batch.column(2), batch.column(3))):
            data = np.frombuffer(unpack.decompress(packed.as_py()), np.uint8)
            parts = pending.values.flatten()
            starts, counts = (np.asarray(p) for p in parts)
            place = np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            for base in range(0, len(data), SEGMENT):
                here = place[(place >= base) & (place < base + SEGMENT)] - base
                if len(here):
                    part = data[base:base + SEGMENT + LENGTH - 1]
                    lead = hasher.at(hasher.prefix(part), here, here + LENGTH)
                    tail = hasher.second(part, here, LENGTH)
                    found.append((lead, tail, here + base, np.ones(len(here), np.int64), np.full(len(here), k)))
                    held += len(here)
            if held > 1 << 18:
                yield _batch(NAMES, batch.column(0), batch.column(1), *map(np.concatenate, zip(*found)))
                found, held = [], 0
        if found:
            yield _batch(NAMES, batch.column(0), batch.column(1), *map(np.concatenate, zip(*found)))


def multikey_sort(lead: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Order by the first token, then only inside runs of equals by the second."""
    order = np.argsort(lead)
    ahead = lead[order]
    equal = np.zeros(len(order) + 1, bool)
    equal[1:-1] = ahead[1:] == ahead[:-1]
    tied = np.flatnonzero(equal[:-1] | equal[1:])
    if len(tied):
        run = np.cumsum(~equal[:-1])[tied]
        order[tied] = order[tied][np.lexsort((tail[order[tied]], run))]
    return order


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sort one bucket; keep suffixes that repeat or are open, and the two at the edges."""
    rows = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if rows is None or not rows.num_rows:
        return
    lead, tail = (rows.column(c).to_numpy() for c in ("lead", "tail"))
    order = multikey_sort(lead, tail)
    a, b = lead[order], tail[order]
    near = np.zeros(len(order) + 1, bool)
    near[1:-1] = a[1:] == a[:-1]
    same = near.copy()
    same[1:-1] &= b[1:] == b[:-1]
    some, full, first = near[:-1] | near[1:], same[:-1] | same[1:], ~same[:-1]
    # a leading token whose tails differ, here or perhaps beyond the boundary
    token = np.cumsum(~near[:-1]) - 1
    mixed_ = np.bincount(token, weights=first) > 1
    mixed_[[0, -1]] = True
    edge = np.zeros(len(order), bool)
    edge[[0, -1]] = True
    open_ = first & mixed_[token]
    kept = np.flatnonzero(some & (full | open_) | edge)
    out = rows.take(pa.array(order[kept]))
    for name, flags in (("same_lead", some), ("same_all", full), ("open", open_), ("edge", edge)):
        out = out.append_column(name, pa.array(flags[kept]))
    yield from out.combine_chunks().to_batches(max_chunksize=1 << 16)


def repeated(suffixes: DataFrame, purpose: str) -> DataFrame:
    """Suffixes with an equal one (``same_all``), and those to look into (``open``).

    Open are the suffixes whose leading token repeats with different tails, one for
    each tail: only their windows can match windows of another tail.
    """
    kinds = ", ".join(f"{n} {t}" for n, t in suffixes.dtypes)
    flags = "same_lead boolean, same_all boolean, open boolean, edge boolean"
    # a bucket is sorted in memory, so buckets are a quarter of the usual size
    buckets = 4 * int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = store(suffixes.repartitionByRange(buckets, "lead", "tail", "doc_id", "start")
                  .mapInArrow(_compare, f"{kinds}, {flags}"), purpose)
    # two rows per partition; a key that fills several partitions has one row in each
    edges = found.where("edge").withColumns({
        "same_lead": F.col("same_lead") | (F.count(F.lit(1)).over(Window.partitionBy("lead")) > 1),
        "same_all": F.col("same_all") | (F.count(F.lit(1)).over(Window.partitionBy("lead", "tail")) > 1),
    })
    return found.where("not edge").union(edges).where("same_lead and (same_all or open)") \
        .drop("edge", "same_lead")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = pa.array([pack.compress(t.as_buffer()) for t in batch.column(2)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], names=["doc_id", "twin", "packed"])


def removed_spans(starts: np.ndarray, counts: np.ndarray) -> list[tuple[int, int]]:
    """Maximal removed byte ranges of the windows that start in the given runs."""
    order = np.argsort(starts, kind="stable")
    begin = starts[order]
    end = np.maximum.accumulate(begin + counts[order] - 1 + LENGTH)
    fresh = np.concatenate([[True], begin[1:] > end[:-1]])
    last = np.append(np.flatnonzero(fresh)[1:] - 1, len(begin) - 1)
    return list(zip(begin[fresh].tolist(), end[last].tolist()))


def _cut(texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            size, gone, count, digest, kept = [], [], [], [], []
            for packed, pending in zip(batch.column(1), batch.column(2)):
                data = unpack.decompress(packed.as_py())
                spans = []
                if pending.is_valid:
                    spans = removed_spans(*(np.asarray(p) for p in pending.values.flatten()))
                rest = hashlib.sha256()
                pieces, at = [], 0
                for begin, end in [*spans, (len(data), len(data))]:
                    rest.update(memoryview(data)[at:begin])
                    if texts:
                        pieces.append(data[at:begin])
                    at = end
                size.append(len(data))
                gone.append(sum(e - b for b, e in spans))
                count.append(len(spans))
                digest.append(rest.hexdigest())
                kept.append(b"".join(pieces))
            columns = [batch.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()),
                       pa.array(count, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if texts:
                columns, names = columns + [pa.array(kept, pa.binary())], names + ["kept"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
    return run


def suffix_dedup(docs: DataFrame, texts: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, one row per row of ``docs``.

    With ``texts`` also the remaining bytes, ``kept``. Null texts are empty; texts
    under 200 bytes lose nothing. Every row is a text of its own, whatever its id:
    rows that repeat an id are told apart by a hash of the text, and rows equal in
    both lose all that both hold. Other columns are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"]
    unique = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty()
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.lit(0).cast("long") if unique else F.xxhash64(text)).alias("twin"),
        text.cast("binary").alias("data"))
    suffixes = rows.where(F.octet_length("data") >= LENGTH).mapInArrow(_run_rows, ROW.format(id=kind))
    first = repeated(suffixes, "suffix-runs")
    packed = rows.mapInArrow(_pack, f"doc_id {kind}, twin long, packed binary")

    def per_document(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(F.col("doc_id").alias("id_"), F.col("twin").alias("twin_")).agg(
            F.collect_list(F.struct("start", "n")).alias(name))

    same = F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("twin") == F.col("twin_"))
    pending = packed.join(per_document(first.where("open"), "pending"), same) \
        .select("doc_id", "twin", "packed", "pending")
    second = repeated(pending.mapInArrow(_window_rows, ROW.format(id=kind)), "suffix-windows")
    spans = per_document(first.where("same_all").union(second.where("same_all")), "spans")
    return packed.join(spans, same, "left").select("doc_id", "packed", "spans").mapInArrow(
        _cut(texts), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
        + (", kept binary" if texts else ""))
