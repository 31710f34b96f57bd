"""The registered queries, run as such: on odd tables, and against brute force on a small one."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from gridweave.llm import queries
from gridweave.llm.common import table

SF = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels embeddings".split()


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """The smallest tables with nulls in every column, empty and repeated rows, and columns whose names the operators use."""
    root = tmp_path_factory.mktemp("odd")
    for name in TABLES:
        df = table(spark, SF, name)
        nothing = spark.createDataFrame([tuple(None for _ in df.columns)], df.schema)
        first = df.limit(1)
        more = [df, nothing, first, first]
        texts = [c for c, k in df.dtypes if k == "string"]
        more += [first.withColumn(c, F.lit(None).cast(df.schema[c].dataType)) for c in df.columns]
        more += [first.withColumn(c, F.lit("")) for c in texts]
        out = more[0]
        for x in more[1:]:
            out = out.union(x)
        for c in ("key", "scan", "label", "shard", "digest", "spread", "hash", "r", "start", "part"):
            out = out.withColumn(c, F.lit(7))
        out.write.parquet(f"{root}/{name}.parquet")
    return str(root)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_tables(spark, odd, name):
    found = queries.QUERIES[name](spark, odd)
    rows = found.collect()
    if name not in ("op5_chunks", "op11_negatives", "pipeline"):
        source = "pages" if name == "op1_warc" else "documents"
        assert len(rows) == table(spark, odd, source).count()
    assert len(set(found.columns)) == len(found.columns)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"pipeline"}))
def test_empty_tables(spark, tmp_path, name):
    for t in TABLES:
        table(spark, SF, t).where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_base_secrets_by_definition(spark):
    """Every base span of sf0.01 by its regular expression, without any screening."""
    sf = "/root/testdata/sf0.01"
    kinds = [("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 6), ("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24)]
    text = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    some = 0
    for r in queries.op10_secrets(spark, sf).collect():
        spans, counts = [], []
        for rank, (kind, pattern, least) in enumerate(kinds):
            own = [m for m in re.finditer(pattern, text[r.doc_id], re.A) if len(m[2] if kind == "assign" else m[0]) >= least]
            counts.append(len(own))
            spans += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in own]
        joined = ",".join(x for _, _, x in sorted(spans))
        some += bool(joined)
        assert [r.n_assign, r.n_access, r.n_hex] == counts and r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))
    assert some > 5


def test_sketch_likeness_by_definition(spark):
    """Where both sketches are whole, the likeness is the Jaccard similarity of the shingle sets."""
    text = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    ids = sorted(text)

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    exact = close = 0
    for r in queries.op6_sketch(spark, SF).collect():
        at = ids.index(r.doc_id)
        following = text[ids[(at + 1) % len(ids)]]
        half = len(text[r.doc_id]) // 2
        edited = text[r.doc_id][: len(text[r.doc_id]) - half] + following[:half]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own = shingles(text[r.doc_id])
        for other, near in ((edited, r.near_edited), (following, r.near_next)):
            two = shingles(other)
            want = len(own & two) / len(own | two) if own or two else 1.0
            if len(own | two) <= 128:
                assert abs(near - want) < 1e-9
                exact += 1
            else:
                assert abs(near - want) < 0.25
                close += 1
    assert exact > 5 and close > 50


def test_held_out_language_and_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in table(spark, sf, "documents").collect()}
    got = [r for r in queries.op4_langid(spark, sf).collect() if r.held_out and lang[r.doc_id]]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in got) > 0.97 * len(got) > 200
    toxic = {r.doc_id: r.toxic for r in table(spark, "/root/testdata/sf0.1", "labels").collect()}
    held = [r for r in queries.op8_toxicity(spark, "/root/testdata/sf0.1").collect() if r.held_out and toxic.get(r.doc_id) is not None]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    caught = [r.predicted for r in held if toxic[r.doc_id] == 1]
    false = [r.predicted for r in held if toxic[r.doc_id] == 0]
    print("toxic", sum(caught), len(caught), sum(false), len(false))
    assert sum(caught) > 0.8 * len(caught) > 50 and sum(false) < 0.02 * len(false)
