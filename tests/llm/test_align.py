"""Operator 13 against both libraries and counting by definition."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from gridweave.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LETTERS = align.byte_of_letter()


@pytest.fixture(scope="module")
def pair():
    return align.Pair(A, B)


def by_definition(rows):
    """The result, token by token."""
    a = tokenizers.Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)

    def spans(pieces):
        at, out = 0, []
        for i, raw in pieces:
            out.append((i, at, at + len(raw)))
            at += len(raw)
        return out, b"".join(raw for _, raw in pieces)

    def tokens(text):
        if not text:
            return None
        first, raw_a = spans([(i, bytes(LETTERS[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids])
        second, raw_b = spans([(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]])
        return (first, second) if raw_a == raw_b == (" " + text).encode() else None

    aligned = []
    for _, text in rows:
        found = tokens(text)
        pairs = [(x[0], y[0]) for x in found[0] for y in found[1] if x[1] < y[2] and y[1] < x[2]] if found else []
        aligned.append((found, pairs))
    holds = Counter(p for _, pairs in aligned for p in set(pairs))
    best = defaultdict(int)
    for (x, _), n in holds.items():
        best[x] = max(best[x], n)
    out = []
    for (doc_id, _), (found, pairs) in zip(rows, aligned, strict=True):
        if not found:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        first, second = found
        ends = sorted({e for *_, e in first} & {e for *_, e in second})
        groups = ";".join(",".join(str(i) for i, _, e in first if low < e <= high) + "|" + ",".join(str(i) for i, _, e in second if low < e <= high) for low, high in zip([0, *ends], ends))
        out.append((doc_id, len(first), len(second), len(ends), len(pairs), sum(holds[p] == best[p[0]] for p in pairs), sum(holds[p] for p in pairs), hashlib.sha256(groups.encode()).hexdigest()))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r))


ODD = [
    (1, "the quick brown fox"), (2, "the quick  brown fox"), (3, None), (4, ""), (5, " leading and trailing "), (6, "<|endoftext|> and <s> are text"),
    (7, "naïve façade Привет 你好 🎉🎉 é ﬁ ½"), (8, "a\tb\nc\r\nd"), (9, "▁ lower block"), (10, "x" * 300), (11, "the quick brown fox"), (11, "the quick brown fox"), (None, "the quick"), (12, "   　"),
]


def test_equals_definition(spark, pair):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = [(i, t if t is None or len(t) < 3000 else t[:3000]) for i, t in docs][:120] + ODD
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, key long, n int")
    want = ordered(by_definition(rows))
    got = align.alignment_digests(df, pair)
    assert ordered(got.collect()) == want
    # A table too large to be shipped is joined instead.
    joined = align.alignment_digests(df, pair, map_pairs=0)
    assert joined.columns == got.columns and ordered(joined.collect()) == want


def test_pieces_give_the_ids_of_the_whole(spark, pair, monkeypatch):
    """Texts in parts against the libraries on whole texts."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").limit(60).collect()]
    texts += [" ".join(texts), "a  b   c \n d\te. \u00a0f \u3000g (h) 1 2 ' x '", "x " * 50 + "  y"] + [t for _, t in ODD if t]
    a, b = tokenizers.Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    for part in (1 << 16, 100):
        monkeypatch.setattr(align, "PART", part)
        t = align.Tokenizers(pair)
        assert t.cuts
        for text in texts:
            own = list(t.parts(text))
            assert [i for p in own for i in t._a_ids(p)] == a.encode(" " + text, add_special_tokens=False).ids
            assert [i for p in own for i in t.b.encode(p)] == b.encode(text)


def test_partial_counts_are_summed(spark, pair, monkeypatch):
    """Small bounds: counts flow through many parts, shards and batches."""
    df = spark.createDataFrame([(i, f"the quick brown fox number {i % 7} jumps") for i in range(300)], "doc_id long, text string").repartition(5)
    want = ordered(by_definition([(r.doc_id, r.text) for r in df.collect()]))
    monkeypatch.setattr(align, "SHARD_PAIRS", 4)
    assert ordered(align.alignment_digests(df, pair).collect()) == want


def test_no_rows_and_groups(spark, pair):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    assert align.alignment_digests(df.where("false"), pair).collect() == []
    assert all(r.n_a == 0 for r in align.alignment_digests(df.where("text is null"), pair).collect())
    groups = {r.doc_id: r.groups for r in align.alignments(df.where("doc_id in (1, 3)"), pair).collect()}
    assert groups[3] is None
    found = align.alignment_digests(df.where("doc_id = 1"), pair).first()
    text = ";".join(",".join(map(str, g.a)) + "|" + ",".join(map(str, g.b)) for g in groups[1])
    assert hashlib.sha256(text.encode()).hexdigest() == found.groups_sha256 and len(groups[1]) == found.n_groups


def test_counts_of_documents(spark, pair):
    """A pair counts once a document."""
    df = spark.createDataFrame([(1, "dog dog dog"), (2, "dog")], "doc_id long, text string")
    assert {r.doc_id: r.count_sum for r in align.alignment_digests(df, pair).select("doc_id", F.col("count_sum")).collect()} == {1: 6, 2: 2}


def test_long_runs(pair):
    """Texts without a place to cut them at, and blanks only."""
    t = align.Tokenizers(pair)
    assert t.ranked
    a = tokenizers.Tokenizer.from_file(A)
    for text in (" " * 130_000, "x" * 130_000, "^" * 300_000, "é" * 70_000, "a" + " " * 200_000 + "b", "\n" * 131_000):
        assert t._a_ids(text) == a.encode(" " + text, add_special_tokens=False).ids


def test_shards_under_a_relative_root_stay_on_its_mount(tmp_path, monkeypatch):
    """An executor's root is "./": what is renamed must not be named by another way to the same folder."""
    import errno
    import os

    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    moved = os.replace

    def by_one_mount(source, target):
        if os.path.isabs(source) != os.path.isabs(target):
            raise OSError(errno.EXDEV, "Invalid cross-device link", source, None, target)
        moved(source, target)

    monkeypatch.chdir(tmp_path)
    monkeypatch.setattr(os, "replace", by_one_mount)
    pq.write_table(pa.table({"key": [3, 5, 9], "n": [1, 4, 2]}), "part-0.parquet")
    assert align.Shards(["part-0.parquet"], ".").counts(np.array([5, 9])).tolist() == [4, 2]
    assert sorted(os.listdir()) == ["part-0.parquet", "part-0.parquet.key.npy", "part-0.parquet.n.npy"]
