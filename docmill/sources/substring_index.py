"""An index for case-blind substring search: posting lists of character trigrams.

A row of the index says which of some documents hold three characters in a row, in
lower case; the text's end counts as two more characters, so that every character and
every pair begins some trigram. Tasks gather the lists of their documents before the
shuffle, cut into pieces of ``PIECE`` ids. Rows are range-partitioned and sorted by
trigram, then first id: a lookup reads the row groups of its trigrams only, and a
trigram of every document is spread over as many files as it needs.

A search intersects the posting lists of a query's rarest trigrams and verifies what
is left against the texts, so its hits are those of a full scan. Queries of one or two
characters take the lists of all trigrams that begin with them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from docmill.session import broadcast_if_small

# Executors need not have this package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GRAM, RAREST = 3, 4     # characters of an entry, and entries of a query that are looked up
PUSHED = 200            # trigrams that a scan is told to look for; more are only joined
END = "\0" * (GRAM - 1)
HELD, PIECE = 1 << 21, 256      # entries that a task gathers by trigram, and those of one row
_BITS = 21                      # of a code point


def _grams(text: str, end: str) -> np.ndarray:
    """The distinct trigrams of a text as numbers."""
    c = np.frombuffer((text + end).encode("utf-32-le"), np.uint32).astype(np.int64)
    if len(c) < GRAM:
        return np.zeros(0, np.int64)
    return np.unique(c[:-2] << 2 * _BITS | c[1:-1] << _BITS | c[2:])


def _spelled(codes: np.ndarray) -> list[str]:
    parts = np.stack([codes >> k * _BITS & (1 << _BITS) - 1 for k in (2, 1, 0)], axis=1)
    text = parts.astype("<u4").tobytes().decode("utf-32-le")
    return [text[k:k + GRAM] for k in range(0, len(text), GRAM)]


def grams(text: Column) -> Column:
    """The distinct trigrams of a query."""
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else _spelled(_grams(v, "")) for v in values.to_pylist()], pa.list_(pa.string()))
    return F.arrow_udf(run, "array<string>")(text)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, text`` to pieces of posting lists ``gram, docs``, gathered inside the task."""
    def emit(ids, codes):
        ids = pa.concat_arrays(ids)
        doc = np.repeat(np.arange(len(ids)), [len(c) for c in codes])
        codes = np.concatenate(codes)
        order = np.argsort(codes, kind="stable")
        codes, doc = codes[order], doc[order]
        place = np.arange(len(codes))
        first = np.concatenate([[True], codes[1:] != codes[:-1]])[:len(codes)]
        start = np.flatnonzero((place - np.maximum.accumulate(np.where(first, place, 0))) % PIECE == 0)
        ends = np.append(start[1:], len(codes))
        for k in range(0, len(start), 1 << 12):
            a, b = start[k:k + (1 << 12)], ends[k:k + (1 << 12)]
            lists = pa.ListArray.from_arrays(
                pa.array(np.append(a, b[-1]) - a[0], pa.int32()), ids.take(pa.array(doc[a[0]:b[-1]])))
            yield pa.RecordBatch.from_arrays([pa.array(_spelled(codes[a])), lists], names=["gram", "docs"])

    ids, codes, held = [], [], 0
    for batch in batches:
        for k, text in enumerate(batch.column(1)):
            if text.is_valid:
                ids.append(batch.column(0).slice(k, 1))
                codes.append(_grams(text.as_py(), END))
                held += len(codes[-1])
            if held > HELD:
                yield from emit(ids, codes)
                ids, codes, held = [], [], 0
    if held:
        yield from emit(ids, codes)


def build(docs: DataFrame, path: str) -> None:
    """Index ``docs (doc_id, text)``, a row per ``doc_id``; null ids and texts have no entries."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.where("doc_id is not null").select("doc_id", F.lower("text").alias("text")).mapInArrow(
        _postings, f"gram string, docs array<{kind}>")
    first = F.col("docs")[0]
    rows.repartitionByRange("gram", first).sortWithinPartitions("gram", first).write.mode("overwrite").option(
        "compression", "zstd").parquet(f"{path}/postings")
    spark = docs.sparkSession
    counts = spark.read.parquet(f"{path}/postings").groupBy("gram").agg(F.sum(F.size("docs")).alias("n"))
    counts.sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/counts")


def candidates(spark: SparkSession, path: str, queries: DataFrame, rarest: int = RAREST) -> DataFrame:
    """``query_id, doc_id``: documents that hold the query's rarest trigrams, or, of a short
    query, a trigram that begins with it. No document that holds the query is missing."""
    postings, counts = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/counts")
    asked = queries.select("query_id", F.lower("query").alias("q")).where("query_id is not null and q <> ''")
    long = asked.where(F.length("q") >= GRAM).select("query_id", F.explode(grams(F.col("q"))).alias("gram"))
    wanted = long.select("gram").distinct()
    known = counts.join(broadcast_if_small(wanted), "gram", "left_semi")
    # a trigram that no document has is the rarest of all, and leaves no candidate
    order = Window.partitionBy("query_id").orderBy("n", "gram")
    chosen = (long.join(known, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
              .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rarest)
              .withColumn("needed", F.count(F.lit(1)).over(Window.partitionBy("query_id"))).select("query_id", "gram", "needed"))
    # a few trigrams reach the scan, which skips all row groups without them
    few = [r.gram for r in chosen.select("gram").distinct().limit(PUSHED + 1).collect()]
    looked = postings.where(F.col("gram").isin(few)) if len(few) <= PUSHED else postings
    met = looked.join(broadcast_if_small(chosen), "gram").select("query_id", "needed", F.explode("docs").alias("doc_id")).groupBy("query_id", "doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.first("needed").alias("needed")).where("n = needed").select("query_id", "doc_id")
    short = asked.where(F.length("q") < GRAM)
    if short.isEmpty():
        return met
    for size in range(1, GRAM):
        if len(starts := [r.q for r in short.where(F.length("q") == size).select("q").distinct().limit(PUSHED + 1).collect()]) == 0:
            continue
        if len(starts) == 1:
            one = postings.where(F.col("gram").startswith(starts[0]))
        some = broadcast_if_small(short.where(F.length("q") == size).withColumnRenamed("q", "start"))
        begun = (one if len(starts) == 1 else postings).withColumn("start", F.substring("gram", 1, size)).join(some, "start")
        met = met.unionByName(begun.select("query_id", F.explode("docs").alias("doc_id")).distinct())
    return met


def search(docs: DataFrame, path: str, queries: DataFrame, k: int = 5, rarest: int = RAREST) -> DataFrame:
    """``query_id, rank, doc_id, text``: the first ``k`` documents by id that hold the query
    ``(query_id, query)``, whatever its case. An empty or null query has no hits."""
    if k < 0:
        raise ValueError("k must not be negative")
    spark = docs.sparkSession
    found = candidates(spark, path, queries, rarest).join(
        broadcast_if_small(queries.select("query_id", F.lower("query").alias("q"))), "query_id")
    verified = found.join(docs.select("doc_id", "text"), "doc_id").where(F.contains(F.lower("text"), F.col("q")))
    order = Window.partitionBy("query_id").orderBy("doc_id")
    return verified.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "doc_id", "text")
