"""The places of chunks and seeds, by definition, for texts with and without letters of several bytes."""

import numpy as np
import pytest

from gridweave.llm import chunks

TEXTS = ["", "a", "plain words " * 50, "z" * 500, "naïve façade 你好 " * 60, "q" * 31, "q" * 33]


@pytest.mark.parametrize("text", TEXTS)
def test_chunks_lie_where_their_characters_do(text):
    raw = text.encode()
    ends = chunks.borders(raw).tolist()
    assert ends == sorted(set(ends)) and ends[-1:] == [len(raw)] * bool(raw)
    _, starts, stops = chunks.chunks(raw)
    before = lambda n: len(raw[:n].decode(errors="ignore")) + (n < len(raw) and raw[n] & 0xC0 == 0x80 and 1)
    assert stops.tolist() == [before(n) for n in ends]
    assert starts.tolist() == [0, *stops.tolist()][: len(ends)]


def test_gear_is_the_sum_of_shifted_bytes():
    data = np.frombuffer(("naïve words " * 9).encode(), np.uint8)
    want = [sum(int(chunks._GEAR[data[i - k]]) << k for k in range(min(32, i + 1))) % (1 << 32) for i in range(len(data))]
    assert chunks.gear(data).tolist() == want
