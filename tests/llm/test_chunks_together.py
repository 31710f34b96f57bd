"""Texts that are cut or compared together give what each gives alone."""

import random

import numpy as np
import pyarrow as pa

from gridweave.llm import chunks

ODD = ["", "a", "z" * 500, "naïve façade 你好 " * 60, "q" * 31, "q" * 33, "\0" * 700, "\0", "é", *("x" * n for n in (95, 96, 97, 192, 193))]


def texts():
    rng = random.Random(3)
    return [*ODD, *("".join(rng.choice("ab é\0") for _ in range(rng.randint(1, 300))) for _ in range(300)), "the same line\n" * 30_000]


def test_cut_together():
    raw = [x.encode() for x in texts()]
    text, *columns = chunks.Laid(raw).seeds()
    for i, own in enumerate(raw):
        n, *alone = chunks.Laid([own]).seeds()
        assert len(n) == (text == i).sum()
        for a, b in zip(columns, alone, strict=True):
            assert np.array_equal(a[text == i], b), i
        # A text's first window of each digest is marked.
        assert len(set(alone[0][alone[3]].tolist())) == alone[3].sum() == len(set(alone[0].tolist()))


def test_rows_of_texts(monkeypatch):
    each = [*texts()[:100], None, *texts()[100:]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(each)), pa.int64()), pa.array(each)], ["doc_id", "text"])
    cut = lambda: pa.Table.from_batches(list(chunks._cut_rows(iter([batch.slice(0, 150), batch.slice(150)])))).to_pydict()
    whole = cut()
    assert set(whole["doc_id"]) == {i for i, x in enumerate(each) if x}
    monkeypatch.setattr(chunks, "_TOGETHER", 1)
    monkeypatch.setattr(chunks, "_ROWS", 50)
    assert cut() == whole
    assert list(chunks._cut_rows(iter([batch.slice(0, 1)]))) == []


def alone(own, other, at_start, at_end, more_before, more_after, min_words):
    """By definition: the maximal equal stretches, and in each the words that have blanks or ends of text around them."""
    n = min(len(own), len(other))
    ends = [i for i in range(n + 1) if i == n or own[i] != other[i]]
    out, begin = [], 0
    for end in ends:
        if end > begin:
            if more_before and begin == 0 or more_after and end == n:
                return None
            blank = lambda i: at_start if i < 0 else at_end if i == len(own) else own[i] in " \t\n\x0b\x0c\r"
            firsts = [i for i in range(begin, end) if blank(i - 1) and not blank(i)]
            lasts = [i + 1 for i in range(begin, end) if not blank(i) and blank(i + 1) and firsts and i >= firsts[0]]
            if end - begin >= 2 * min_words - 1 and len(lasts) >= min_words and lasts:
                out.append((firsts[0], lasts[-1], len(lasts)))
        begin = end + 1
    return out


def test_compared_together():
    rng = random.Random(5)
    pairs = [("", "", True, True, True, True)]
    for _ in range(800):
        own = list(" ".join(rng.choice(["ab", "c", "déf", "你"]) for _ in range(rng.choice([0, 1, 5, 40]))))
        other = [rng.choice("q \n") if rng.random() < 0.02 else c for c in own]
        own, other = ("".join(x)[: len(x) - rng.choice([0, 0, 3])] for x in (own, other))
        pairs.append((own, other, *(rng.random() < 0.5 for _ in range(2)), *(rng.random() < 0.2 for _ in range(2))))
    for least in (1, 2, 9):
        assert chunks.common(pairs, least) == [alone(*p, least) for p in pairs]
    assert list(chunks._together([])) == [] and list(chunks._together([1, chunks._TOGETHER, 5])) == [slice(0, 2), slice(2, 3)]
