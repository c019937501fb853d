"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time 0..1, piecewise linear. Its
integral, scaled to the source's target, is the source's cumulative demand for
words. A source's documents are queued in a fixed pseudo-random order, for as many
passes as the target asks; the n-th word of the queue is due when the cumulative
demand reaches n, which inverts to a training position. Documents are range-sorted
by the position at which they first appear.

Prefix sums are two-level (sums per bucket of the order key, then inside a
bucket), so that a source with a third of all rows is no single task; rows equal in
id, source and text are counted per partition first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docmill.llm.common import store

# Weights of the sources in order, repeating, and passes at most.
WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
# Weight schedules in the same cycle: (time, relative weight) knots.
SCHEDULES = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)
ROWS_PER_BUCKET = 20_000


def integrated(knots) -> list[tuple[float, float, float, float, float, float]]:
    """Segments ``(t0, t1, w0, w1, share before, share after)``; shares end at 1."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    total, done, out = sum(areas), 0.0, []
    for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas):
        out.append((t0, t1, w0 / total, w1 / total, done, done + area / total))
        done += area / total
    return out


def _double(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def position(kind: str, share: str, schedules=SCHEDULES) -> str:
    """SQL for the time at which ``share`` of a schedule's integral is reached."""
    cases = []
    for k, knots in enumerate(schedules):
        parts = integrated(knots)
        for n, (t0, t1, w0, w1, before, after) in enumerate(parts):
            d, bend = f"({share} - {_double(before)})", (w1 - w0) / (t1 - t0)
            limit = f" AND {share} < {_double(after)}" if n + 1 < len(parts) else ""
            cases.append(f"WHEN {kind} = {k}{limit} THEN {_double(t0)} + {_double(2)} * {d} / "
                         f"({_double(w0)} + sqrt({_double(w0 * w0)} + {_double(2 * bend)} * {d}))")
    return f"CASE {' '.join(cases)} END"


def words(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """Add ``kind`` (place in the cycle) and ``target`` to ``source, source_size``.

    Sources in code point order, null last. All words are shared out by weight; a
    source above ``max_passes`` times its size stops there and its excess is
    reshared. With the sources sorted by limit over weight, the first k are at
    their limit for the first k whose remaining level fits the next source. One
    row per source, so the global windows here see names, not documents.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*map(F.lit, weights))
    ranked = sizes.withColumn("kind", ((F.row_number().over(order) - 1) % len(weights)).cast("int"))
    ranked = ranked.withColumn("weight", F.element_at(cycle, F.col("kind") + 1).cast("long")) \
        .withColumn("cap", F.col("source_size") * max_passes)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    leveled = ranked.withColumns({
        "left": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "rest": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    }).withColumn("level", F.col("left") / F.col("rest"))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    whole = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return leveled.withColumn("level", F.first(fits, ignorenulls=True).over(whole)).select(
        "source", "source_size", "kind",
        F.when(F.col("level").isNull() | (F.col("cap") / F.col("weight") <= F.col("level")), F.col("cap").cast("double"))
        .otherwise(F.col("weight") * F.col("level")).alias("target"))


def mix(docs: DataFrame, schedules=SCHEDULES, weights=WEIGHTS, max_passes: int = MAX_PASSES,
        carry: str | None = None) -> DataFrame:
    """``doc_id, size, source_size, target, taken, position`` range-sorted by position.

    ``taken`` counts the words the mix takes from a document, all passes together;
    a source's sum to its target rounded to a whole word. ``position`` (0 to 1) is
    where the document first appears, null if it isn't taken. A null text has size
    0, a null source is a source of its own, equal ids are rows of their own; rows
    equal in id, source and text are interchangeable, each with a share of its own.
    An empty table gives no rows. ``carry`` names a column to pass through.
    """
    carried = [] if carry is None else [F.col(carry).alias("carried")]
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = store(docs.select(
        "doc_id", "source", words("text").alias("size"), *carried,
        F.md5(F.concat(F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("-")), F.lit("|"), F.md5(text))).alias("key"),
        F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "sizes")
    digits, rows = 0, sized.count()
    while rows > ROWS_PER_BUCKET * 16 ** digits:
        digits += 1
    # equal rows have equal sizes: they are counted by partition, so that however many
    # there are, none of the sums below sees them one by one
    before_part = Window.partitionBy("source", "key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    equal = store(sized.groupBy("source", "key", "size", "part").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "ahead", F.coalesce(F.sum("n").over(before_part), F.lit(0))), "equal-rows")
    keys = equal.groupBy("source", "key").agg(F.sum(F.col("n") * F.col("size")).alias("words")).withColumn(
        "bucket", F.substring("key", 1, digits))
    sums = store(keys.groupBy("source", "bucket").agg(F.sum("words").alias("words")), "bucket-sizes")
    plan = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_passes)
    offset = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("offset", F.coalesce(F.sum("words").over(offset), F.lit(0))).alias("s")
    plan = starts.join(plan.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source"))).select(
        F.col("s.source").alias("source_"), F.col("s.bucket").alias("bucket_"), "offset",
        "source_size", "kind", "target").withColumn("whole", F.floor(F.col("target") + 0.5))
    inside = Window.partitionBy("source", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    placed = keys.withColumn("inside", F.coalesce(F.sum("words").over(inside), F.lit(0))).join(
        plan, F.col("source").eqNullSafe(F.col("source_")) & (F.col("bucket") == F.col("bucket_"))).select(
        "source", "key", (F.col("offset") + F.col("inside")).alias("first"), "source_size", "kind", "target", "whole")
    in_part = Window.partitionBy("source", "key", "part").orderBy("row")
    queued = sized.withColumn("nth", F.row_number().over(in_part) - 1).alias("r").join(
        equal.select(F.col("source").alias("source_"), F.col("key").alias("key_"), F.col("part").alias("part_"), "ahead"),
        F.col("key").eqNullSafe(F.col("key_")) & F.col("source").eqNullSafe(F.col("source_")) & (F.col("part") == F.col("part_"))
    ).drop("source_", "key_", "part_").join(
        placed.withColumnsRenamed({"source": "source_", "key": "key_"}),
        (F.col("key") == F.col("key_")) & F.col("source").eqNullSafe(F.col("source_")))
    queued = queued.withColumn("start", F.col("first") + (F.col("ahead") + F.col("nth")) * F.col("size"))
    passes = F.when(F.col("source_size") > 0, F.expr("whole div source_size")).otherwise(0)
    part = F.col("whole") - passes * F.col("source_size") - F.col("start")
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(part, F.col("size")))
    return queued.withColumn("taken", taken.cast("long")).withColumn(
        "share", F.when(F.col("taken") > 0, F.col("start") / F.col("whole"))
    ).withColumn("position", F.expr(position("kind", "share", schedules))).select(
        "doc_id", "size", "source_size", "target", "taken", "position",
        *([] if carry is None else [F.col("carried").alias(carry)])
    ).orderBy("position", "doc_id")
