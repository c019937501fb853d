"""Exact dedup by deterministic block naming.

Every text is cut into blocks of fixed size. Equal blocks get one integer name, by
sorting the distinct blocks; then adjacent names are paired and the pairs named
again, until each document has one name. Names are given to whole values, never to
hashes, so two documents share an identity exactly if their texts are equal.

Only DataFrame functions. Distinct blocks and pairs are pre-aggregated in each
task. Blocks with over a thousandth of all rows, under a thousand of them, are named
first and reach their rows by broadcast; the other joins are of stored tables, whose
hot keys adaptive execution splits. So a block or text that a third of all documents
hold is no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docmill.llm.common import store

BLOCK_BYTES = 4096
COMMON_SHARE = 1000
MISSING = -1     # the right half of an odd last block; no block has this name


def name_documents(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``row, doc_id, text_sha256, level, name``: one identity per row of ``docs``.

    A null text counts as empty (one empty block). Null and repeated ids are rows
    of their own: ``row`` identifies a row. Other columns are ignored.
    """
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", data.alias("data"),
        F.sha2(data, 256).alias("text_sha256"),
        F.greatest(F.lit(1), F.ceil(F.octet_length(data) / block_bytes)).cast("int").alias("n"))
    blocks = rows.select(
        "row", "doc_id", "text_sha256", "n",
        F.posexplode(F.expr(
            f"transform(sequence(0, n - 1), i -> substring(data, i * {block_bytes} + 1, {block_bytes}))"
        )).alias("i", "block"))
    blocks = blocks.withColumns({
        c: F.when(F.col("i") == 0, F.col(c)) for c in ("doc_id", "text_sha256")})
    common = F.broadcast(_common_names(blocks))
    apart = blocks.join(common, "block", "left")
    rare = apart.where("name is null").drop("name")
    named = store(
        apart.where("name is not null").drop("block").unionByName(
            rare.join(_names(rare, ["block"]), "block").drop("block")), "block-names")

    top = named.where("i = 0").select("row", "doc_id", "text_sha256", "n", "name")
    identities = top.where("n = 1").select("row", F.lit(0).alias("level"), "name")
    current = named.where("n > 1").select("row", "n", "i", "name")
    level, width = 0, named.agg(F.max("n")).first()[0] or 1
    while width > 1:
        level, width = level + 1, (width + 1) // 2
        pairs = current.groupBy(
            "row", F.expr("i div 2").cast("int").alias("i"), F.ceil(F.col("n") / 2).cast("int").alias("n")
        ).agg(F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("left"),
              F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(MISSING)).alias("right"))
        names = store(_names(pairs, ["left", "right"]), "names")
        current = store(pairs.join(names, ["left", "right"])
                        .select("row", "n", "i", "name"), "pair-names")
        identities = identities.union(
            current.where("n = 1").select("row", F.lit(level).alias("level"), "name"))
        current = current.where("n > 1")
    return top.drop("n", "name").join(identities, "row")


def _common_names(blocks: DataFrame) -> DataFrame:
    """Names, below -1 (a missing right half), of the blocks with over a thousandth of all rows: under a
    thousand (more only by hash collisions), found by counting hashes."""
    counts = blocks.groupBy(F.xxhash64("block").alias("hash")).count()
    total = blocks.select("n").where("i = 0").agg(F.sum("n")).first()[0] or 0
    hashes = counts.where(F.col("count") * COMMON_SHARE > total).select("hash")
    found = blocks.select("block", F.xxhash64("block").alias("hash")).join(F.broadcast(hashes), "hash", "left_semi")
    return store(_names(found, ["block"]).withColumn("name", MISSING - 1 - F.col("name")), "common-names")


def _names(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct values of ``keys`` with a name: partition and rank in its sorted order."""
    return (df.select(*keys).distinct().sortWithinPartitions(*keys)
            .withColumn("name", F.monotonically_increasing_id()))


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, one row per row of ``docs``.

    Of rows with equal texts the one with the largest ``doc_id`` is kept (nulls are
    smallest; of fully equal rows any one). An empty table gives no rows.
    """
    named = store(name_documents(docs, block_bytes), "identities")
    groups = store(named.groupBy("level", "name").agg(
        F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size")), "groups")
    return named.join(groups, ["level", "name"]).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256")
