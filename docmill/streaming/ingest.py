"""Incremental upload: files that arrive in a folder go into a document store.

Files come in any order, late, and more than once. A stateful step keeps, for every
file name, the version and the digest of the newest content it has seen, and lets a
file through only if it is newer and its content another. So whatever the order of
arrival and however it falls into batches, the store ends with the same documents as
a batch job over all files; the state lives in the checkpoint and outlives restarts.
"""

from __future__ import annotations

import sys
import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docmill.sources import files, store

# Executors need not have this package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def arriving_files(
    spark: SparkSession, folder: str, max_files: int = 10_000,
    name: Callable[[Column], Column] = files.base_name, version: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """A stream of ``(filename, content, version)`` over a folder and those in it. Files
    must not change after they land; a new version of a document is a new file. Its
    name and, unless it is the time of the file, its version come from the path."""
    return (
        spark.readStream.format("binaryFile").schema(files.FILE_SCHEMA)
        .option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true")
        .load(folder)
        .select(
            name(F.col("path")).alias("filename"), "content",
            (F.unix_micros("modificationTime") if version is None else version(F.col("path")).cast("long")).alias("version"),
        )
    )


def _newer(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The newest of a name's files, if it is newer than what was seen and differs from it."""
    seen = state.get if state.exists else None
    best, content = seen, None
    for batch in batches:
        for version, digest, data in zip(batch["version"], batch["digest"], batch["content"]):
            if best is None or (version, digest) > tuple(best):
                best, content = (int(version), digest), data
    if content is not None:
        state.update(best)
        if seen is None or seen[1] != best[1]:
            yield pd.DataFrame({"filename": [key[0]], "content": [content], "version": [best[0]]})


def newest_files(stream: DataFrame) -> DataFrame:
    """``filename, content, version``: of every name, each content that is newer than all
    before it. Equal versions rank by the digest of their content, so that the order of
    arrival never counts. The state holds two values per name."""
    digested = stream.withColumns({
        "filename": F.coalesce("filename", F.lit("")), "content": F.coalesce("content", F.lit(b"")),
        "version": F.coalesce("version", F.lit(0)).cast("long")})
    return digested.withColumn("digest", F.sha2("content", 256)).groupBy("filename").applyInPandasWithState(
        _newer, "filename string, content binary, version long", "version long, digest string",
        "append", GroupStateTimeout.NoTimeout)


def newest_of(rows: DataFrame) -> DataFrame:
    """The same of a table: the newest row of every name."""
    order = F.struct(F.coalesce("version", F.lit(0)).cast("long"), F.sha2(F.coalesce("content", F.lit(b"")), 256))
    return rows.groupBy(F.coalesce("filename", F.lit("")).alias("filename")).agg(
        F.max_by(F.struct("content", "version"), order).alias("r")).select("filename", "r.content", "r.version")


def named_records(batch: DataFrame) -> DataFrame:
    """Records whose id is a hash of the file name, so that a new version replaces the old."""
    texts = files.read_texts(batch)
    return files.to_records(texts.withColumn("doc_id", F.sha2("filename", 256)))


def ingest(
    stream: DataFrame, root: str, checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame] = lambda batch: files.to_records(
        files.read_texts(batch)
    ),
) -> StreamingQuery:
    """Upsert everything that has arrived, then stop. Sets how many tasks of the session
    list files to four times its cores, if it is more.

    A batch is written under the query's id, which its checkpoint keeps, and its
    own, so a batch repeated after a failure replaces itself, and a query with a new
    checkpoint replaces nothing.
    """
    started, query = threading.Event(), []

    def write(batch: DataFrame, batch_id: int) -> None:
        started.wait()
        batch.persist()     # `prepare` may take it apart: files are read and the state is kept once
        try:
            store.upsert(prepare(batch), root, batch_id, writer=f"stream-{query[0].id}")
        finally:
            batch.unpersist()

    # a batch lists each of its files, by default in a task of its own; this stays set, as
    # the stream lists them whenever a batch begins
    conf = stream.sparkSession.conf
    conf.set(LISTING, str(min(int(conf.get(LISTING)), 4 * stream.sparkSession.sparkContext.defaultParallelism)))
    running = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.append(running)
    started.set()
    return running
