"""Benchmark items without an id."""

from gridweave.llm import decontam


def test_items_without_an_id_hit(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, "five six"), (3, "seven")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "two three"), (None, "one two"), (7, "five six"), (8, "four"), (None, None)], "item_id long, text string")
    for size in (1 << 20, 3):
        got = {r.doc_id: (r.n_hit, r.n_items, r["items"], r.contaminated) for r in decontam.contamination(docs, bench, set_windows=size).collect()}
        assert got == {1: (4, 2, ["8"], True), 2: (2, 1, ["7"], True), 3: (0, 0, [], False)}
    assert [r.doc_id for r in decontam.decontaminate(docs, bench).collect()] == [3]
