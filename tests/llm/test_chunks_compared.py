"""Texts on either side of alignments: what is found once for each text, and where words may begin and end."""

from gridweave.llm import chunks

WORDS = [f"wört{i * 7919 % 1009}" for i in range(400)]


def test_texts_are_measured_once(spark):
    shared = " ".join(WORDS[:60])
    texts = spark.createDataFrame([(1, shared), (2, "vor " + shared + "s")], "doc_id long, text string")
    aligned = spark.createDataFrame([(2, 1, 4, 10, 80)], "doc_id long, other long, shift int, low int, high int")
    found = chunks._compared(texts, aligned, 512, 49)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("length(text") == plan.count("xxhash64(text") == 1
    # The last word goes on in one of the texts.
    assert [tuple(r) for r in found.drop("print").collect()] == [(2, 4, len("vor " + " ".join(WORDS[:59])), 59, 1, 4, 10, 80)]


def test_words_at_the_edges_of_parts(spark):
    """Passages at the beginnings and ends of texts, and beyond the first margin."""
    shared = " ".join(WORDS)
    own = {1: shared, 2: shared + " end", 3: "x" + shared, 4: "naïve\n" + shared + "\tmore", 5: shared[:-1]}
    rows = spark.createDataFrame(list(own.items()), "doc_id long, text string")
    found = {r.doc_id: own[r.doc_id][r.start : r.end] for r in chunks.repeated_passages(rows).collect()}
    # 1 is compared with 5, whose last word is another one; a word is whole that is in its own document.
    assert found == {1: shared.rpartition(" ")[0], 2: shared, 3: shared.partition(" ")[2], 4: shared, 5: shared[:-1]}
