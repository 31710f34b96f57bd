"""The stages one after the other, on the smallest tables, and their contracts."""

from pyspark.sql import functions as F

import corpus_pipeline
from gridweave.llm import decontam, langid, secrets

from .test_neardup import _kept

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("fp", F.lit(1))
    columns = docs.columns
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF).persist()
        if name != "BPE":
            assert after.columns == columns, name
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        came = {r.doc_id for r in before.select("doc_id").collect()}
        if name == "near dedup":
            assert ids == _kept([(r.doc_id, r.text) for r in before.collect()])
        elif name == "decontamination":
            hit = {r.doc_id for r in decontam.contamination(before, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").collect()}
            assert ids == came - hit and hit
        elif name == "secrets":
            texts = {r.doc_id: r.text for r in before.collect()}
            for r in after.collect():
                assert r.text == secrets.redact(texts[r.doc_id], secrets.secrets_in(texts[r.doc_id])) and r.n_chars == len(r.text)
        elif name == "BPE":
            assert after.where("not round_trip").count() == 0 and ids == came
        else:
            assert len(ids) > 0.98 * len(came)
        before = after


def test_odd_documents(spark, docs):
    """Null, empty and wordless texts, missing ids and repeated rows go through every stage."""
    before = docs.withColumn("lang", F.lit("en"))
    for _, stage in corpus_pipeline.STAGES:
        before = stage(spark, before, SF).persist()
    left = {r.doc_id for r in before.collect()}
    assert not left & {3, 4, 5, 6} and 1 in left and 2 not in left
    assert langid.UNKNOWN == "und"


def test_empty(spark, no_docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, SF).count() == 0


def test_registered(spark):
    import __spark_entry__

    assert {"pipeline", *(f"op{n}" for n in range(1, 11))} <= {q.split("_")[0] for q in __spark_entry__.queries()}
