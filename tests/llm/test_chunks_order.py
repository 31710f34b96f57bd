"""Chunks that hold only a part of a character."""

import numpy as np

from gridweave.llm import chunks


def test_runs_are_not_broken_within_a_character(spark):
    rng = np.random.default_rng(11)
    letters = [chr(c) for c in range(0x430, 0x450)]
    rows = []
    while len(rows) < 60:
        shared = " ".join("".join(rng.choice(letters, 6)) for _ in range(60))
        _, start, end = chunks.chunks(shared.encode())
        if (start[1:-1] == end[1:-1])[5:-5].any():
            for _ in range(2):
                head = " ".join("".join(rng.choice(letters, 6)) for _ in range(12))
                rows.append((len(rows), head + " " + shared))
    got = chunks.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == list(range(60))
    assert all(r.n_words >= 45 for r in got)
