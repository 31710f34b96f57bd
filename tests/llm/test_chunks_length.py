"""Passages have the length that they have in the other document."""

import random

import pytest

from gridweave.llm import chunks
from gridweave.llm.common import table

WORDS = [f"w{i}x{i * 7919 % 1000}" for i in range(5000)]


def text(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def passages(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return chunks.repeated_passages(df).collect()


def test_shared_beyond_another_documents_part(spark):
    """2 and 3 share 600 words, of which 1 has the first half: each is told of all 600."""
    shared = text(600, 1)
    half = " ".join(shared.split()[:300])
    rows = [(1, text(80, 2) + " " + half + " " + text(80, 3)), (2, text(90, 4) + " " + shared + " " + text(90, 5)), (3, text(70, 6) + " " + shared + " " + text(60, 7))]
    found = {}
    for r in passages(spark, rows):
        found.setdefault(r.doc_id, []).append((r.first_doc, r.n_words))
    assert [n for other, n in found[2] if other == 3] == [600] and [n for other, n in found[3] if other == 2] == [600]
    assert [n for _, n in found[1]] == [300]


@pytest.mark.parametrize("line", ["the same line of words, again and again\n", "".join(f"{w} " for w in WORDS[:300])])
def test_equal_documents_are_one_passage(spark, line):
    whole = (line * 2000)[:23_500]
    found = passages(spark, [(1, whole), (2, whole), (3, whole + " and more"), (4, "nothing in common")])
    own = {r.doc_id: r for r in found if r.doc_id < 3}
    assert len(found) - sum(r.doc_id == 3 for r in found) == 2
    for r in own.values():
        assert (r.start, r.end) == (0, len(whole.rstrip())) and r.n_words == len(whole.split())


def longest(a, b):
    """The words of the longest stretch that two texts share, by definition: over all offsets."""
    x, y = a.split(), b.split()
    best, row = 0, {}
    places = {}
    for j, w in enumerate(y):
        places.setdefault(w, []).append(j)
    for w in x:
        row = {j: row.get(j - 1, 0) + 1 for j in places.get(w, ())}
        best = max([best, *row.values()])
    return best


def test_lengths_by_definition(spark):
    """The longest passage of a document is as long as what it shares with any document named for it."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r.doc_id: r.text for r in docs.collect() if r.text}
    named = {}
    for r in chunks.repeated_passages(docs).collect():
        named.setdefault(r.doc_id, []).append(r)
    assert len(named) > 50
    whole = tried = 0
    for doc_id, own in sorted(named.items()):
        others = {r.first_doc for r in own}
        if max(len(texts[i]) for i in (doc_id, *others)) > 12_000:
            continue
        tried += 1
        want = max(longest(texts[doc_id], texts[o]) for o in others)
        got = max(r.n_words for r in own)
        assert got <= want + 2
        whole += got >= want - 2
    print("whole", whole, "of", tried)
    assert whole >= 0.98 * tried > 40
