"""The maintained corpus summary against recomputation."""

import random
import shutil

from pyspark.sql import functions as F

from docmill.plans.corpus_report import corpus_report
from docmill.sources import store, summary

KIND = ("doc_id string, analytics struct<file_type:string,legality_score:int,total_pages:int,total_names:int,total_emails:int,"
        "total_phones:int,total_signers:int,total_clauses:int,clause_summary:map<string,int>>, at long")


def record(rng, doc_id, at=0):
    clauses = None if rng.random() < 0.2 else {c: rng.randrange(4) for c in rng.sample(["due", "court", "law", "x"], 3)}
    return (doc_id, (rng.choice([None, "pdf", "docx"]), rng.choice([None, 0, 40, 77]), *(rng.choice([None, 1, 2, 5]) for _ in range(6)), clauses), at)


def same(spark, root, current):
    got = summary.report(spark, root).first().asDict()
    want = corpus_report(spark.createDataFrame(list(current.values()), KIND)).first().asDict()
    assert got == want


def test_three_upserts_equal_a_recomputation(spark, tmp_path):
    rng, root, current = random.Random(4), str(tmp_path), {}
    same(spark, root, current)
    for batch in range(4):
        rows = [record(rng, f"d{rng.randrange(60)}", k) for k in range(40)]
        summary.commit(spark.createDataFrame(rows, KIND), root, batch, version="at", buckets=4)
        for r in rows:
            current[r[0]] = r
        same(spark, root, current)
        if batch == 1:
            summary.compact(spark, root)
            summary.compact(spark, root)
            same(spark, root, current)


def test_a_repeated_batch_takes_its_own_place(spark, tmp_path):
    rng, root = random.Random(5), str(tmp_path)
    put = lambda batch, ids: summary.commit(
        spark.createDataFrame(rows := [record(rng, i) for i in ids], KIND), root, batch, buckets=2) or {r[0]: r for r in rows}
    first, second = put(0, ["a", "b", "gone"]), put(1, ["b", "c"])
    again = put(0, ["a", "b"])      # without one document, and older than batch 1
    assert set(first) - set(again) == {"gone"}
    same(spark, root, again | second)
    summary.compact(spark, root)
    same(spark, root, again | second)


def test_a_lost_change_is_made_up_for(spark, tmp_path):
    rng, root, current = random.Random(6), str(tmp_path), {}
    for batch in range(3):
        rows = [record(rng, f"d{k}") for k in rng.sample(range(20), 8)]
        summary.commit(spark.createDataFrame(rows, KIND), root, batch, buckets=2)
        current |= {r[0]: r for r in rows}
    shutil.rmtree(f"{root}/changes/seq=1")
    same(spark, root, current)


def test_reading_scans_changes_only(spark, tmp_path):
    rng, root = random.Random(7), str(tmp_path)
    summary.commit(spark.createDataFrame([record(rng, f"d{k}") for k in range(50)], KIND), root, 0)
    plan = summary.report(spark, root)
    assert plan.inputFiles() and all("/changes/" in f for f in plan.inputFiles())
    assert spark.read.parquet(f"{root}/changes/seq=0").count() <= 3 * 4 + 4
    assert store.read(spark, f"{root}/facts", summary.FACTS).where(F.col("clauses").isNull()).count() == 0


def test_the_maintained_report_analyses_each_document_once(spark, sf, monkeypatch):
    from workload import reports

    seen, plain = spark.sparkContext.accumulator(0), reports.analyses

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    def watched(spark, sf_dir):
        rows = plain(spark, sf_dir).limit(60)
        return rows.mapInArrow(counted, rows.schema)

    monkeypatch.setattr(reports, "analyses", watched)
    assert reports.maintained_report(spark, sf).first().total_documents == 60 and seen.value == 60
