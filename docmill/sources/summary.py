"""A corpus summary that stays current: partial aggregates, kept with every commit.

Beside the analyses, a store (see ``store``) keeps one slim row of facts per document:
its file type, score, totals and clause counts. Every commit of it leaves a change:
the aggregate of its documents as they are now minus that of the same documents as
they were before, in as many rows as there are file types, scores and clauses. The
summary is the sum of all changes, so reading it scans neither analyses nor facts,
and a document that is replaced is subtracted exactly once.

A change is a function of the commits alone. One that is missing, as the job was lost
between commit and change, is made up for before the next commit, read or compaction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from docmill.fixed_values import UNKNOWN_TYPE
from docmill.operators.corpus import TOTALS
from docmill.plans.corpus_report import fold
from docmill.session import broadcast_if_small
from docmill.sources import store

FACTS = T.StructType([
    T.StructField("doc_id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("score", T.IntegerType()),
    *(T.StructField(t, T.LongType()) for t in TOTALS),
    T.StructField("clauses", T.MapType(T.StringType(), T.LongType())),
])
_CHANGE = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("score", T.IntegerType()), T.StructField("docs", T.LongType()),
    *(T.StructField(t, T.LongType()) for t in TOTALS),
    T.StructField("clause", T.StringType()), T.StructField("n", T.LongType()), T.StructField("holders", T.LongType()),
])


def facts(analyses: DataFrame, version: str | None = None) -> DataFrame:
    """The facts of analysis records; ``version`` names a column that orders rows of one
    id in a batch. Missing values are those that the report assumes."""
    clauses = F.coalesce("analytics.clause_summary", F.expr("cast(map() as map<string,int>)")).cast("map<string,bigint>")
    return analyses.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.coalesce("analytics.file_type", F.lit(UNKNOWN_TYPE)).alias("kind"),
        F.coalesce("analytics.legality_score", F.lit(0)).alias("score"),
        *[F.coalesce(f"analytics.{t}", F.lit(0)).cast("long").alias(t) for t in TOTALS],
        clauses.alias("clauses"),
        (F.col(version) if version else F.lit(0)).cast("long").alias("version"))


def commit(analyses: DataFrame, root: str, batch_id: int, writer: str = "batch", version: str | None = None,
           buckets: int = store.BUCKETS) -> None:
    """Add a batch of analysis records to the summary. An id that is there already is
    replaced, and a batch that its writer repeats takes the place of its earlier attempt."""
    spark = analyses.sparkSession
    catch_up(spark, root)
    store.upsert(facts(analyses, version), f"{root}/facts", batch_id, writer, buckets)
    catch_up(spark, root)


def _aggregate(signed: DataFrame) -> DataFrame:
    """Rows of facts with a ``sign`` to a change."""
    sign = F.col("sign")
    kinds = signed.groupBy("kind", "score").agg(
        F.sum(sign).alias("docs"), *[F.sum(sign * F.col(t)).alias(t) for t in TOTALS])
    clauses = signed.select("sign", F.explode("clauses").alias("clause", "count")).groupBy("clause").agg(
        F.sum(sign * F.col("count")).alias("n"), F.sum(sign).alias("holders"))
    return kinds.unionByName(clauses, allowMissingColumns=True)


def _sum(changes: DataFrame) -> DataFrame:
    """Changes added up; what no document has any more is gone."""
    kinds = changes.where("clause is null").groupBy("kind", "score").agg(
        *[F.sum(c).alias(c) for c in ("docs", *TOTALS)]).where("docs <> 0")
    clauses = changes.where("clause is not null").groupBy("clause").agg(
        F.sum("n").alias("n"), F.sum("holders").alias("holders")).where("holders <> 0")
    return kinds.unionByName(clauses, allowMissingColumns=True)


def _done(spark: SparkSession, root: str) -> tuple[list[int], int]:
    """Commits whose change is there, and the last one that is summed up."""
    names = [n for n in store._children(spark, f"{root}/changes") if "_SUCCESS" in store._children(spark, f"{root}/changes/{n}")]
    return store._numbers(names, "seq"), max(store._numbers(names, "upto"), default=-1)


def catch_up(spark: SparkSession, root: str) -> None:
    """Write the change of every commit that has none yet."""
    where = f"{root}/facts"
    done, upto = _done(spark, root)
    commits = [c for c in store._commits(spark, where) if c.complete]
    for c in commits:
        if c.seq <= upto or c.seq in done:
            continue
        # an earlier attempt of the same batch is undone, so its documents change, too
        attempts = [e for e in commits if e.seq <= c.seq and (e.writer, e.batch_id) == (c.writer, c.batch_id)]
        rows, touched = store._commit_rows(spark, where, attempts, {}, FACTS, None)
        ids = broadcast_if_small(rows.select("doc_id").distinct(), max_rows=1_000_000)
        signed = None
        for sign, at in ((1, c.seq), (-1, c.seq - 1)):
            state = store.read(spark, where, FACTS, touched, upto=at).join(ids, "doc_id", "left_semi").withColumn("sign", F.lit(sign))
            signed = state if signed is None else signed.unionByName(state)
        _aggregate(signed).coalesce(1).write.mode("overwrite").parquet(f"{root}/changes/seq={c.seq}")


def _changes(spark: SparkSession, root: str) -> DataFrame:
    done, upto = _done(spark, root)
    paths = [f"{root}/changes/seq={s}" for s in done if s > upto] + ([f"{root}/changes/upto={upto}"] if upto >= 0 else [])
    if not paths:
        return spark.createDataFrame([], _CHANGE)
    return spark.read.schema(_CHANGE).parquet(*paths)


def report(spark: SparkSession, root: str) -> DataFrame:
    """The corpus report (see ``plans.corpus_report``) from the changes alone."""
    catch_up(spark, root)
    return fold(_sum(_changes(spark, root)))


def compact(spark: SparkSession, root: str) -> None:
    """Fold the changes into one and the facts into their base."""
    catch_up(spark, root)
    done, upto = _done(spark, root)
    if any(s > upto for s in done):
        _sum(_changes(spark, root)).coalesce(1).write.mode("overwrite").parquet(f"{root}/changes/upto={max(done)}")
    store.compact(spark, f"{root}/facts", FACTS)
