"""Operator 12: targets by definition, exact takes, the tree's distribution."""

from collections import Counter, defaultdict
from math import comb

import pytest
from pyspark.sql import functions as F

from gridweave.llm import mixing, queries

SF = "/root/testdata/sf0.01"


def shares(sizes: dict, weights=(5, 2, 1), share=1.5, most=2):
    """Targets as the rule says: full sources stop, their excess goes to the others by weight."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(most * sizes[s] for s in full)
        given = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if given[s] > most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) if s in full else given[s] for s in names}
        full |= over


def test_targets_and_takes(spark):
    found = queries.op12_mixing(spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sizes, taken = Counter(), Counter()
    for r in found:
        assert r.size == len([w for w in (docs[r.doc_id].text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if w])
        assert 0 <= r.taken <= 2 * r.size
        sizes[docs[r.doc_id].source] += r.size
        taken[docs[r.doc_id].source] += r.taken
    want = shares(sizes)
    for r in found:
        source = docs[r.doc_id].source
        assert r.source_size == sizes[source] and r.target == pytest.approx(want[source], rel=1e-12)
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)
    again = queries.op12_mixing(spark.newSession(), SF)
    assert sorted(map(tuple, again.repartition(3).collect())) == sorted(map(tuple, found))


def test_odd_rows(spark, docs):
    """Null texts, ids and sources, repeated rows, a source without words, one very long text."""
    rows = docs.withColumn("source", F.when(F.col("doc_id") < 4, "a").when(F.col("doc_id") == 5, "none").when(F.col("doc_id") == 7, "b"))
    made = mixing.mix(rows, shards=3, block_words=64)
    found = mixing.taken_words(made).collect()
    assert len(found) == rows.count() and all(0 <= r.taken <= 2 * r.size for r in found)
    assert sum(r.taken for r in found) == pytest.approx(1.5 * sum(r.size for r in found), abs=2)
    assert all(r.taken == 0 for r in found if r.size == 0)
    texts = mixing.mixed_texts(rows, made).collect()
    words = Counter()
    for r in texts:
        words[r.doc_id] += len(r.text.split())
    per_doc = Counter()
    for r in found:
        per_doc[r.doc_id] += r.taken
    assert words == Counter({k: n for k, n in per_doc.items() if n})
    by_shard = defaultdict(list)
    for r in texts:
        by_shard[r.shard].append(r.position)
    assert all(sorted(p) == list(range(len(p))) for p in by_shard.values())
    assert mixing.taken_words(mixing.mix(rows.where("false"))).count() == 0
    none = mixing.taken_words(mixing.mix(rows.where("doc_id in (3, 4, 5)"))).collect()
    assert len(none) == 3 and all(r.target == 0 and r.taken == 0 for r in none)


def test_pieces_are_disjoint(spark):
    """In one pass no word of a document is taken twice, and shards have equal numbers of blocks."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = mixing.mix(docs, shards=7, block_words=100)
    spans = defaultdict(list)
    for r in made.pieces.collect():
        spans[r.doc, r["pass"]].append((r.first_word, r.first_word + r.words))
    for own in spans.values():
        own.sort()
        assert all(a[1] <= b[0] for a, b in zip(own, own[1:]))


def test_tree_gives_exact_quotas(spark):
    counts = spark.createDataFrame([(1, 0, 1000), (2, 0, 37), (3, 0, 1), (4, 9, 0)], "k1 long, k2 long, n long")
    got = mixing.splitting_tree(counts, 11, seed=4).collect()
    room, own = Counter(), defaultdict(list)
    for r in got:
        room[r.shard] += r.n
        own[r.k1].append((r.first, r.first + r.n))
    assert sum(room.values()) == 1038 and max(room.values()) - min(room.values()) <= 1
    for k, n in ((1, 1000), (2, 37), (3, 1)):
        own[k].sort()
        assert own[k][0][0] == 0 and own[k][-1][1] == n and all(a[1] == b[0] for a, b in zip(own[k], own[k][1:]))


@pytest.mark.parametrize(("total", "good", "draws"), [(20, 7, 9), (100, 50, 50), (60, 3, 40)])
def test_draws_are_hypergeometric(spark, total, good, draws):
    n = 20_000
    lit = lambda x: F.lit(x).cast("long")
    got = spark.range(n).select(mixing.hypergeometric(lit(total), lit(good), lit(draws), mixing.uniform(F.col("id"))).alias("x")).groupBy("x").count().collect()
    for r in got:
        p = comb(good, r.x) * comb(total - good, draws - r.x) / comb(total, draws)
        assert abs(r["count"] / n - p) < 5 * (p / n) ** 0.5 + 1e-3
    assert sum(r["count"] for r in got) == n


def test_large_draws(spark):
    """Counts of billions: within six deviations of the mean."""
    lit = lambda x: F.lit(x).cast("long")
    got = spark.range(20).select(mixing.hypergeometric(lit(4_000_000), lit(1_000_000), lit(2_000_000), mixing.uniform(F.col("id"))).alias("x")).collect()
    deviation = (2_000_000 * 0.25 * 0.75 * 0.5) ** 0.5
    assert all(abs(r.x - 500_000) < 6 * deviation for r in got) and len({r.x for r in got}) > 15
