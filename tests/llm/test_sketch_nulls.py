"""Rows without an id among many ranges."""

import hashlib
from collections import Counter

from pyspark.sql import functions as F

from gridweave.llm import sketch


def test_pieces_with_null_ids(spark):
    """Ids far apart and many pieces: no product of longs overflows, and order is kept."""
    ids = [0, 1, 2, 3, 1 << 61, (1 << 61) + 1, (1 << 62) + 5, -(1 << 62), *range(5000, 5500)]
    df = spark.createDataFrame([(i, False) for i in ids] + [(-(1 << 63), True), ((1 << 63) - 1, True), (0, True)], "key long, late boolean")
    edges = [-(1 << 62), 0, 5100, 1 << 61, (1 << 62) + 6]
    part = sketch._part_of(F.col("late"), F.col("key"), edges, 3, 4)
    got = [(r.late, r.key, r.part) for r in df.select("late", "key", part.alias("part")).collect()]
    parts = [p for _, _, p in sorted(got)]
    assert parts == sorted(parts) and min(parts) >= 0
    assert all((p >= 3 * (len(edges) - 1)) == late for late, _, p in got)
    assert len({p for late, _, p in got if late}) == 3


def test_neighbours_with_null_ids(spark, monkeypatch):
    """Few quantiles, so that stretches are cut into pieces; each row is edited with its next one."""
    monkeypatch.setattr(sketch, "QUANTILES", 4)
    rows = [(i * 7, f"text number {i} of the table") for i in range(40)] + [(None, f"nameless text {i}, one of them") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = [(None if r.doc_id is None else r.doc_id, r.edited_sha256) for r in sketch.neighbours(df, rows=3).collect()]
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] if r[0] is not None else hashes[r[1]]))
    want = []
    for (i, own), (_, following) in zip(order, [*order[1:], order[0]], strict=True):
        half = len(own) // 2
        want.append((i, hashlib.sha256((own[: len(own) - half] + following[:half]).encode()).hexdigest()))
    assert Counter(pairs) == Counter(want)


def test_null_ids_are_dealt(spark):
    df = spark.range(1000).select(F.lit(True).alias("late"), F.xxhash64("id").alias("key"))
    sizes = df.groupBy(sketch._part_of(F.col("late"), F.col("key"), [0, 1], 1, 10).alias("p")).count().collect()
    assert len(sizes) == 10 and max(r["count"] for r in sizes) < 200
