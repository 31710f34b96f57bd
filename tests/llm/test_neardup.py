"""The near-dedup stage of the pipeline against brute-force Jaccard groups."""

import numpy as np

import corpus_pipeline
from gridweave.llm import simhash


def _shingles(text, size=5):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def _jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def _kept(rows):
    """The smallest id of each group, all pairs compared."""
    sets = {i: _shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if _jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in ids if find(i) == i}


def _rows():
    """Texts with edited copies, some of them over and some under 0.8, chains, and a crowded group."""
    rng = np.random.default_rng(7)
    vocabulary = [f"w{x}" for x in range(3000)]
    texts = []
    for n in (30, 60, 120, 250, 600):
        for edits in (1, 2, 3, 4, 6, 9):
            words = [vocabulary[i] for i in rng.integers(0, 3000, n)]
            texts.append(words)
            for _ in range(3):
                words = list(words)
                for at in rng.integers(0, n, max(1, edits * n // 120)):
                    words[at] = "new"
                texts.append(words)
    base = [vocabulary[i] for i in rng.integers(0, 3000, 80)]
    for i in range(40):
        texts.append([*base[: i % 20], f"own{i}", *base[i % 20 + 1 :]])
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    return [*rows, (1000, None), (1001, ""), (1002, "two words"), (1003, "Two  words"), (1002, "two words")]


def test_stage_equals_brute_force(spark):
    rows = _rows()
    docs = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string")
    got = [r.doc_id for r in corpus_pipeline.deduplicate(spark, docs, "").collect()]
    want = _kept(rows)
    assert sorted(i for i in got if i is not None) == sorted(want) and got.count(None) == 1
    assert len(want) < len({i for i, _ in rows}) - 60
    far = [(a, b) for (i, a), (j, b) in zip(rows, rows[1:]) if a and b and a != b and _jaccard(_shingles(a), _shingles(b)) >= 0.8 and (simhash.simhash(a.encode()) ^ simhash.simhash(b.encode())).bit_count() > 3]
    assert len(far) > 10  # pairs that fingerprints of radius 3 don't link


def test_blocks_lose_nothing(spark):
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in simhash.similar_groups(docs, block=4, block_shingles=300).collect()} == _kept(rows)


def test_candidates_at_the_threshold():
    """Sets of similarity 0.8 agree in a band, nearly all of them."""
    rng = np.random.default_rng(8)
    missed = 0
    for _ in range(300):
        own = rng.integers(0, 1 << 63, 100).astype(np.uint64)
        a, b = own[:90], np.concatenate([own[:80], own[90:]])
        missed += not set(simhash.set_bands(a)) & set(simhash.set_bands(b))
    assert missed == 0


def test_rows_of_one_id(spark):
    """Of several rows with one id one stays, whatever the order they come in."""
    rows = [(1, "b c d", "x"), (1, "a b c", "y"), (1, "a b c", "w"), (2, "a b c", "z"), (3, None, "v"), (3, None, "v"), (None, "a b c", "u")]
    kept = [(1, "a b c", "w"), (3, None, "v"), (None, "a b c", "u")]
    for some in (rows, rows[::-1]):
        docs = spark.createDataFrame(some, "doc_id long, text string, r string")
        for way in (simhash.deduplicate, simhash.deduplicate_similar):
            assert sorted(map(tuple, way(docs).collect()), key=str) == sorted(kept, key=str)
