"""Byte-level BPE encoding and decoding with given ranks (operator 9).

Each match of the split pattern is encoded on its own: a piece that is a token is that
token; any other is backtracked from longest matches.  An Aho-Corasick automaton over the
tokens, with bytes mapped to Latin-1 characters, gives the longest token at each position;
a token is kept only if it is compatible with the one before it, which means that exact
merging would never join bytes across their border.  Compatibility of a pair is memoised,
and positions that can't be continued are marked, so the work is linear in the piece.

The automaton is rebuilt once per Python worker from the broadcast ranks (their number is
fixed by the vocabulary file).  Pieces are memoised, up to twice MEMO entries per worker.

Defined cases: null counts as empty, which has no tokens and decodes to the empty string.
Each row is encoded by itself: repeated rows have equal ids, null and repeated doc_ids don't
matter, an empty table gives an empty result, and a very long text is split and packed in
steps of _STEP pieces, a single long piece in time linear in it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm.common import ids_and_text, strings

MEMO = 1 << 16
PAIR_MEMO = 1 << 18
_STEP = 1 << 16
_PACK = [struct.Struct(f"<{n}I") for n in range(64)]


def read_ranks(path: str) -> dict[bytes, int]:
    """A file of lines `base64(token) rank`."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """Exact merging by definition: join the leftmost adjacent pair of the lowest rank until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
        if best >= (1 << 62 if below is None else below):
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Tables:
    """What encoding needs besides the ranks: the two parts that each token was merged from."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = pattern
        if missing := [i for i in range(256) if bytes([i]) not in ranks]:
            raise ValueError(f"bytes without a token: {missing}")
        size = max(ranks.values()) + 1
        self.tokens: list[bytes | None] = [None] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        left, right = np.arange(size, dtype=np.int32), np.arange(size, dtype=np.int32)
        for token, rank in ranks.items():
            if len(token) > 1:
                parts = merge(token, ranks, rank)
                if len(parts) != 2:
                    raise ValueError(f"token {token!r} isn't reached by merges of lower rank")
                left[rank], right[rank] = ranks[parts[0]], ranks[parts[1]]
        self.left, self.right = left, right


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, tables: Tables):
        self.tokens = tables.tokens
        self.ranks = {t: i for i, t in enumerate(self.tokens) if t is not None}
        self.left, self.right = tables.left.tolist(), tables.right.tolist()
        self.joined = {(self.left[i], self.right[i]): i for t, i in self.ranks.items() if len(t) > 1}
        self.split = regex.compile(tables.pattern)
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def compatible(self, a: int, b: int) -> bool:
        """_compatible, memoised up to PAIR_MEMO pairs."""
        key = a << 24 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIR_MEMO:
                self.pairs.clear()
            found = self.pairs[key] = self._compatible(a, b)
        return found

    def _compatible(self, a: int, b: int) -> bool:
        """Whether exact merging of a's bytes and b's bytes, side by side, leaves a and b as they are.

        Undo merges at the border from the latest back; a pair met there would have been
        merged if its rank is below all that was undone since.
        """
        limit = 1 << 62
        while True:
            if self.joined.get((a, b), limit) < limit:
                return False
            if a > b:
                limit, part = a, self.right[a]
                if part == a:
                    limit, part = b + 1, self.left[b]
                    if part == b:
                        return True
                    b = part
                else:
                    a = part
            else:
                limit, part = b + 1, self.left[b]
                if part == b:
                    limit, part = a, self.right[a]
                    if part == a:
                        return True
                    a = part
                else:
                    b = part

    def _prefix(self, token: int) -> int:
        """The longest proper prefix that is a token, or -1."""
        found = self.shorter.get(token)
        if found is None:
            whole, found = self.tokens[token], -1
            for n in range(len(whole) - 1, 0, -1):
                if (rank := self.ranks.get(whole[:n])) is not None:
                    found = rank
                    break
            self.shorter[token] = found
        return found

    def piece(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n, tokens = len(piece), self.tokens
        longest = [0] * (n + 1)
        # Matches come by their end, so the last one at a start is the longest; each byte is a token.
        for end, (size, rank) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - size] = rank
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[-1]
        while at < n:
            end = at + len(tokens[token])
            if not dead[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at - 1]
            elif (less := self._prefix(token)) >= 0:
                token = less
            else:
                dead[at] = 1
                token = out.pop()
                at -= len(tokens[token])
        return out

    def _packed(self, piece: str) -> bytes:
        found = self.memo.get(piece)
        if found is None:
            found = self.older.get(piece)
            if found is None:
                ids = self.piece(piece.encode())
                found = (_PACK[len(ids)] if len(ids) < len(_PACK) else struct.Struct(f"<{len(ids)}I")).pack(*ids)
            if len(self.memo) >= MEMO:
                self.older, self.memo = self.memo, {}
            if len(piece) <= 64:
                self.memo[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        packed = self._packed
        if len(text) <= _STEP:
            return b"".join(map(packed, self.split.findall(text)))
        pieces, out = (m.group() for m in self.split.finditer(text)), []
        while part := list(islice(pieces, _STEP)):
            out.append(b"".join(map(packed, part)))
        return b"".join(out)

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, "<u4")
        token = self.tokens.__getitem__
        return b"".join(b"".join(map(token, ids[i : i + _STEP].tolist())) for i in range(0, len(ids), _STEP))


#: The codec of this worker, by name.
_codecs: dict[str, Codec] = {}


class Tokenizer:
    """Encoding and decoding as columns.  `path` names a rank file, `pattern` the split of texts into pieces."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        self.tables = Tables(read_ranks(path), pattern)
        shared = spark.sparkContext.broadcast(self.tables)
        name = hashlib.sha256((path + pattern).encode()).hexdigest()

        def codec() -> Codec:
            if name not in _codecs:
                _codecs.clear()
                _codecs[name] = Codec(shared.value)
            return _codecs[name]

        @F.arrow_udf("binary")
        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = codec()
            for texts in batches:
                yield pa.array((own.encode(x or "") for x in strings(texts)), pa.binary())

        @F.arrow_udf("binary")
        def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = codec()
            for packed in batches:
                yield pa.array((own.decode(x or b"") for x in strings(packed)), pa.binary())

        @F.arrow_udf("struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>")
        def round_trip(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own, sha = codec(), lambda x: hashlib.sha256(x).hexdigest()
            for texts in batches:
                packed = [own.encode(x or "") for x in strings(texts)]
                yield pa.StructArray.from_arrays(
                    [pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array(map(sha, packed), pa.string()), pa.array((sha(own.decode(x)) for x in packed), pa.string())],
                    ["n_tokens", "ids_sha256", "decoded_sha256"],
                )

        @F.arrow_udf("struct<ids:binary,same:boolean>")
        def checked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = codec()
            for texts in batches:
                ids, same = [], []
                for text in strings(texts):
                    ids.append(own.encode(text or ""))
                    same.append(own.decode(ids[-1]) == (text or "").encode())
                yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(same, pa.bool_())], ["ids", "same"])

        self._encode, self._decode, self._round_trip, self._checked = encode, decode, round_trip, checked

    def encode(self, text: Column | str) -> Column:
        """The ids, packed as little-endian unsigned 32-bit integers."""
        return self._encode(text)

    def decode(self, packed: Column | str) -> Column:
        """The bytes that packed ids stand for."""
        return self._decode(packed)

    def checked(self, text: Column | str) -> Column:
        """Struct of the packed ids and whether they decode to the text's bytes: both in one Python worker."""
        return self._checked(text)

    def round_trip(self, text: Column | str) -> Column:
        """Struct of the number of tokens and digests of the ids and of the bytes decoded from them."""
        return self._round_trip(text)


def token_digests(docs: DataFrame, tokenizer: Tokenizer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every document."""
    return ids_and_text(docs, id_col, text_col).select("doc_id", tokenizer.round_trip("text").alias("r")).select("doc_id", "r.*")


def tokenize(docs: DataFrame, tokenizer: Tokenizer, text_col: str = "text", ids: str = "token_ids", count: str = "n_tokens", same: str | None = None) -> DataFrame:
    """The documents with their packed ids and number of tokens, and, if `same` names a column
    for it, whether these decode to the text; columns of these names are replaced."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("r"), F.col(f"`{text_col}`").alias("text"))
    made = rows.select("r", (tokenizer.encode("text") if same is None else tokenizer.checked("text")).alias("made"))
    packed = F.col("made") if same is None else F.col("made.ids")
    added = {ids: packed, count: (F.octet_length(packed) / 4).cast("long")} | ({} if same is None else {same: F.col("made.same")})
    kept = [F.col("r").getField(c).alias(c) for c in docs.columns if c not in added]
    return made.select(*kept, *(c.alias(n) for n, c in added.items()))
