"""What the operators share: tables between jobs and connected components."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from docmill.session import work_dir

# Executors need not have this package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules["docmill.llm"])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, purpose: str, made: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the cluster's shared folder and read it back.

    Cuts the lineage with data that outlives any executor, and fixes ids such as
    ``monotonically_increasing_id`` for all later readers. What the job shuffled goes when
    it ends; else it would stay until the driver collects its garbage. The folder's name is
    added to ``made``, for :func:`discard`.
    """
    path, conf = work_dir(df.sparkSession, purpose), df.sparkSession.conf
    if made is not None:
        made.append(path)
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before) if before is not None else conf.unset(CLEANUP)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, made: list[str]) -> None:
    """Delete stored tables that nothing reads any more."""
    for name in made:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """Connected components of ``(a long, b long)``: ``(node, component)``.

    The component is its smallest node. Large-star and small-star steps alternate
    until nothing changes, each a minimum per node and a join; no neighbourhood is
    ever collected, and hot nodes are pre-aggregated or split by the skew join.
    Nulls and self-links are ignored; no edges give no rows.
    """
    spark = edges.sparkSession
    star = store(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a is not null and b is not null and a <> b").distinct(), purpose)
    state = _state(star)
    while state[0]:
        both = star.union(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # a node's own smaller neighbours; all links of `large` point to a smaller node
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        star = store(small.union(low.select("a", F.col("m").alias("b"))).distinct(), purpose)
        before, state = state, _state(star)
        if before == state:
            break
    roots = star.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return star.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"),
                    F.expr("sum(pmod(xxhash64(b, a), 1000003))")).first()
    return tuple(row)
