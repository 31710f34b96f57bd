"""Alignment of two tokenizers' tokens and counts of aligned pairs (operator 13).

Tokenizer A, a byte-level BPE, encodes a space and the text; tokenizer B, a piece BPE, the
text, to which it adds the space.  Both token sequences lie on the same bytes.  Places where
tokens of both end cut them into groups; an A and a B token that share bytes are linked.
There is one link for each stretch between neighbouring token ends, of either side, so links
are read off the merged ends.

A pair of ids is packed into one integer (A's id in the upper 32 bits).  How many documents
have a pair linked is counted in each partition by np.unique, partial counts are range-
partitioned and sorted, and runs of equal keys are summed, across batches too: what comes out
is a sorted table in shards, by A's id first.  For the lookup each executor gets the shards
as files (SparkContext.addFile) and maps them into memory, so that its workers share them;
keys are found by searchsorted.  Pairs number at most what the vocabularies allow; a table of
more than MAP_PAIRS is not shipped: links are joined with it instead.

Texts are encoded once, their ids written to the shared folder (two bytes an id for these
vocabularies).  Texts of over PART characters are encoded in parts cut at a space between two
letters, where both tokenizers always cut: A's pattern never has a space behind another
character in one match, and no piece of B's vocabulary has (checked when it is read).

Defined cases: null and empty texts, and texts whose tokens' bytes aren't a space and the
text on both sides, have no tokens: zeros and an empty groups_sha256.  Rows without an id or
with a repeated one are documents like others.  Ties for the highest count all count as best.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm.common import cut, ids_and_text, scratch, small_batches

#: Characters of a text that are encoded at once, about.
PART = 1 << 16
#: Pairs that a partition counts before it hands them on.
PARTIAL = 1 << 20
#: Pairs to a shard of the sorted table, about, and shards at most.
SHARD_PAIRS = 1 << 20
MAX_SHARDS = 256
#: Pairs in a table that is shipped to executors: 2 GB of keys and counts.
MAP_PAIRS = 1 << 27
#: Bytes of texts that are aligned at once.
GROUP_BYTES = 4 << 20
_SPACE = "▁"
_CUT = regex.compile(r"(?<=\p{L}) (?=\p{L})")
_SHIFT = 32
# The byte-level splitter of such files, and the pattern it stands for.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Pair:
    """Two tokenizers by their files: a `tokenizers` JSON and a `sentencepiece` model."""

    def __init__(self, a_path: str, b_path: str):
        with open(a_path, "rb") as f:
            self.a_file = f.read()
        with open(b_path, "rb") as f:
            self.b_file = f.read()
        self.name = hashlib.sha256(self.a_file + self.b_file).hexdigest()


def byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a letter: itself if it can be printed, else one from 256 on."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printed]
    return {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers as a worker has them."""

    def __init__(self, pair: Pair):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(pair.a_file)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=pair.b_file)
        letters = byte_of_letter()
        model, before = json.loads(pair.a_file)["model"], json.loads(pair.a_file)["pre_tokenizer"]
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        added = {t["content"] for t in json.loads(pair.a_file).get("added_tokens", [])}
        for token, i in vocabulary.items():
            self.a_bytes[i] = token.encode() if token in added else bytes(letters[c] for c in token)
        self.b_bytes = [self._b_bytes(i) for i in range(self.b.get_piece_size())]
        #: Whether no piece has a space behind another character, so that texts can be cut at one.
        self.cuts = not any(b" " in x.lstrip(b" ") for x in self.b_bytes)
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
        in_order = all(vocabulary.get(m) == len(letters) + i for i, m in enumerate(merged)) and len(merged) + len(letters) == len(model["vocab"])
        plain = model.get("ignore_merges") is False and before == BYTE_LEVEL and json.loads(pair.a_file)["normalizer"] is None
        self.ranked = None
        if in_order and plain:
            from tiktoken import Encoding

            self.ranked = Encoding("a", pat_str=PATTERN, mergeable_ranks={self.a_bytes[i]: i for i in model["vocab"].values()}, special_tokens={})
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.kinds = tuple(np.dtype("<u2") if len(side) <= 1 << 16 else np.dtype("<u4") for side in (self.a_bytes, self.b_bytes))
        # An id with what follows it in the text form of groups.
        table = lambda side, ends: np.array([f"{i}{end}".encode() for end in ends for i in range(len(side))], object)
        self.a_texts, self.b_texts = table(self.a_bytes, ",|"), table(self.b_bytes, ",;")

    def _b_bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return b"" if self.b.is_control(i) or self.b.is_unknown(i) else piece.replace(_SPACE, " ").encode()

    def parts(self, text: str) -> Iterator[str]:
        """The text in parts of some PART characters that may be encoded one by one, without the spaces between them."""
        at = 0
        while self.cuts and len(text) - at > PART and (found := _CUT.search(text, at + PART)):
            yield text[at : found.start()]
            at = found.end()
        yield text[at:]

    def _a_ids(self, text: str) -> list[int]:
        """A's ids of a space and a text.  If A's ids are in the order of its merges they are ranks, by which merging is faster."""
        if self.ranked and len(text) <= 2 * PART:
            return self.ranked.encode_ordinary(" " + text)
        return self.a.encode(" " + text, add_special_tokens=False).ids

    def encode(self, text: str) -> tuple[bytes, bytes] | None:
        """The packed ids of both sides, or None if their bytes aren't a space and the text."""
        parts = list(self.parts(text))
        whole = b" " + text.encode()
        out = []
        for ids_of, size, side, kind in ((self._a_ids, self.a_size, self.a_bytes, self.kinds[0]), (self.b.encode, self.b_size, self.b_bytes, self.kinds[1])):
            ids = [ids_of(p) for p in parts]
            own = np.concatenate([np.array(x, kind) for x in ids])
            sizes = size[own]
            if sizes.sum() != len(whole) or not sizes.all() or b"".join(side[i] for x in ids for i in x) != whole:
                return None
            out.append(own.tobytes())
        return out[0], out[1]


_workers: dict[str, Tokenizers] = {}


def _tokenizers(pair: Pair) -> Tokenizers:
    if pair.name not in _workers:
        _workers.clear()
        _workers[pair.name] = Tokenizers(pair)
    return _workers[pair.name]


class Links:
    """What documents' tokens share, documents laid end to end: both sides of one have the same bytes.

    Token ends are marks on the bytes; a stretch between neighbouring marks is a link of the
    A and the B token it lies in, and marks of both sides end groups.
    """

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], t: Tokenizers):
        self.a, self.b = np.concatenate(a), np.concatenate(b)
        ends_a, ends_b = np.cumsum(t.a_size[self.a]), np.cumsum(t.b_size[self.b])
        marks = np.zeros(int(ends_a[-1]) + 1, np.uint8)
        marks[ends_a] = 1
        marks[ends_b] |= 2
        at = np.flatnonzero(marks)
        kind = marks[at]
        is_a, is_b, both = kind & 1, kind >> 1, kind == 3
        through_a, through_b, through = np.cumsum(is_a, dtype=np.int64), np.cumsum(is_b, dtype=np.int64), np.cumsum(both, dtype=np.int64)
        #: The links' keys, in order.
        self.keys = self.a[through_a - is_a] << _SHIFT | self.b[through_b - is_b]
        group = through - both
        self.a_group, self.b_group = group[is_a.view(bool)], group[is_b.view(bool)]
        #: How many tokens of each side the groups so far have.
        self.a_through, self.b_through = through_a[both], through_b[both]
        docs = np.searchsorted(at, ends_a[np.cumsum([len(x) for x in a]) - 1])
        #: Where each document's links and groups end.
        self.ends, self.group_ends = docs + 1, through[docs]

    def texts(self, t: Tokenizers) -> np.ndarray:
        """The ids of all groups as texts, each with the mark behind it, in the order of the text form."""
        last_a, last_b = (np.concatenate((g[1:] != g[:-1], [True])) for g in (self.a_group, self.b_group))
        before = np.concatenate(([0], self.b_through[:-1]))
        out = np.empty(len(self.a) + len(self.b), object)
        out[np.arange(len(self.a)) + before[self.a_group]] = t.a_texts[self.a + len(t.a_bytes) * last_a]
        out[np.arange(len(self.b)) + self.a_through[self.b_group]] = t.b_texts[self.b + len(t.b_bytes) * last_b]
        return out


def _encoded(batches: Iterator[pa.RecordBatch], pair) -> Iterator[pa.RecordBatch]:
    t = _tokenizers(pair.value)
    for batch in batches:
        sides: tuple[list, list] = ([], [])
        for text in batch.column("text"):
            found = t.encode(text.as_py()) if text.is_valid and len(text.as_buffer()) else None
            for side, ids in zip(sides, found or (None, None), strict=True):
                side.append(ids)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(s, pa.binary()) for s in sides)], ["doc_id", "a", "b"])


def _documents(batch: pa.RecordBatch, t: Tokenizers) -> Iterator[tuple[list[int], list[np.ndarray], list[np.ndarray]]]:
    """A batch's rows that have tokens, in groups of some GROUP_BYTES of ids: their numbers and ids."""
    at, a, b, size = [], [], [], 0
    for i, (x, y) in enumerate(zip(batch.column("a"), batch.column("b"), strict=True)):
        if x.is_valid:
            at.append(i)
            a.append(np.frombuffer(x.as_buffer(), t.kinds[0]).astype(np.int64))
            b.append(np.frombuffer(y.as_buffer(), t.kinds[1]).astype(np.int64))
            size += a[-1].nbytes + b[-1].nbytes
            if size > GROUP_BYTES:
                yield at, a, b
                at, a, b, size = [], [], [], 0
    if at:
        yield at, a, b


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal neighbouring keys as one."""
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _table(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], ["key", "n"])


def _partial_counts(batches: Iterator[pa.RecordBatch], pair) -> Iterator[pa.RecordBatch]:
    """(key, n): in how many of a partition's documents a pair is linked."""
    t = _tokenizers(pair.value)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(keys, kind="stable")
        return _summed(keys[order], counts[order])

    for batch in batches:
        for _, a, b in _documents(batch, t):
            found = Links(a, b, t)
            own = [np.unique(k) for k in np.split(found.keys, found.ends[:-1])]
            held.append(np.unique(np.concatenate(own), return_counts=True))
            size += len(held[-1][0])
            if size > 2 * PARTIAL:
                held = [merged()]
                size = len(held[0][0])
                if size > PARTIAL:
                    yield _table(*held[0])
                    held, size = [], 0
    if held:
        yield _table(*merged())


def _run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, n) with equal keys summed; a batch's last key waits for the next batch."""
    waiting = (np.empty(0, np.int64), np.empty(0, np.int64))
    for batch in batches:
        keys, counts = (np.concatenate((w, batch.column(c).to_numpy())) for w, c in zip(waiting, ("key", "n"), strict=True))
        keys, counts = _summed(keys, counts)
        if len(keys):
            yield _table(keys[:-1], counts[:-1])
            waiting = (keys[-1:], counts[-1:])
    yield _table(*waiting)


def pair_counts(encoded: DataFrame, pair) -> DataFrame:
    """(key, n) for every linked pair, sorted: written in shards, each of one range of keys."""
    spark = encoded.sparkSession
    counted = cut(encoded.select("a", "b").where("a is not null").mapInArrow(partial(_partial_counts, pair=pair), "key long, n long"))
    shards = min(MAX_SHARDS, 1 + counted.count() // SHARD_PAIRS)
    path = scratch(spark, "pairs")
    counted.repartitionByRange(shards, "key").sortWithinPartitions("key").mapInArrow(_run_lengths, "key long, n long").write.parquet(path)
    return spark.read.schema("key long, n long").parquet(path)


class Shards:
    """The sorted table as a worker sees it: arrays of each shard, mapped into memory."""

    def __init__(self, files: list[str], root: str):
        self.parts = []
        for name in files:
            keys, counts = (f"{root}/{name}.{c}.npy" for c in ("key", "n"))
            if not os.path.exists(counts):
                own = pq.read_table(f"{root}/{name}", columns=["key", "n"])
                for path, column in ((keys, "key"), (counts, "n")):  # counts last: they say that both are there
                    # Named like the file it becomes: a relative root may lie on another mount than its absolute path.
                    with open(unfinished := f"{path}.{uuid.uuid4().hex}", "wb") as f:
                        np.save(f, own.column(column).to_numpy())
                    os.replace(unfinished, path)
            part = tuple(np.load(p, mmap_mode="r") for p in (keys, counts))
            if len(part[0]):
                self.parts.append(part)
        self.parts.sort(key=lambda p: p[0][0])
        self.lows = np.array([p[0][0] for p in self.parts], np.int64)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The counts of sorted keys, all of which the table has."""
        out = np.empty(len(keys), np.int64)
        borders = [*np.searchsorted(keys, self.lows).tolist(), len(keys)]
        for (own, n), low, high in zip(self.parts, borders, borders[1:], strict=False):
            out[low:high] = n[np.searchsorted(own, keys[low:high])]
        return out


_DIGESTS = "doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _looked_up(batches: Iterator[pa.RecordBatch], pair, best, files: list[str]) -> Iterator[pa.RecordBatch]:
    t, shards, highest = _tokenizers(pair.value), Shards(files, SparkFiles.getRootDirectory()), best.value

    def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, at = np.unique(keys, return_inverse=True)
        counts = shards.counts(own)
        return counts[at], (counts == highest[own >> _SHIFT])[at]

    for batch in batches:
        yield _digested(batch, t, counted)


def _digested(batch: pa.RecordBatch, t: Tokenizers, counted=None) -> pa.RecordBatch:
    """The result's columns; without counts also what a join needs to give them."""
    numbers = np.zeros((len(_NAMES), batch.num_rows), np.int64)
    digests, keys_of = [""] * batch.num_rows, [b""] * batch.num_rows
    for at, a, b in _documents(batch, t):
        found = Links(a, b, t)
        keys, ends = found.keys, found.ends
        n_links = np.diff(ends, prepend=0)
        n_a, n_b = ([len(x) for x in side] for side in (a, b))
        numbers[:4, at] = n_a, n_b, np.diff(found.group_ends, prepend=0), n_links
        if counted:
            counts, is_best = counted(keys)
            starts = ends - n_links
            numbers[4:, at] = np.add.reduceat(is_best.astype(np.int64), starts), np.add.reduceat(counts, starts)
        else:
            for i, own in zip(at, np.split(keys, ends[:-1]), strict=True):
                keys_of[i] = own.astype("<i8").tobytes()
        texts, first = found.texts(t), 0
        for i, n in zip(at, np.cumsum(np.add(n_a, n_b)).tolist(), strict=True):
            digests[i] = hashlib.sha256(b"".join(texts[first:n].tolist())[:-1]).hexdigest()
            first = n
    out = [batch.column("doc_id"), *map(pa.array, numbers), pa.array(digests, pa.string())]
    names = ["doc_id", *_NAMES, "groups_sha256"]
    return pa.RecordBatch.from_arrays(out if counted else [*out, pa.array(keys_of, pa.binary())], names if counted else [*names, "keys"])


def _joined(encoded: DataFrame, counts: DataFrame, pair, best, kind: str) -> DataFrame:
    """The result where the table is too large to be shipped: each document's links are joined with it."""

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizers(pair.value)
        for batch in batches:
            yield _digested(batch, t)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, packed in zip(batch.column("row").to_pylist(), batch.column("keys"), strict=True):
                keys, n = np.unique(np.frombuffer(packed.as_buffer(), "<i8"), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), row)), pa.array(keys), pa.array(n, pa.int64())], ["row", "key", "times"])

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            is_best = batch.column("n").to_numpy() == best.value[batch.column("key").to_numpy() >> _SHIFT]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), pa.array(is_best)], ["key", "n", "best"])

    rows = cut(encoded.mapInArrow(digested, _DIGESTS.format(kind=kind) + ", keys binary").withColumn("row", F.monotonically_increasing_id()))
    met = rows.select("row", "keys").where("n_links > 0").mapInArrow(opened, "row long, key long, times long")
    table = counts.mapInArrow(highest, "key long, n long, best boolean")
    sums = met.join(table, "key").groupBy("row").agg(F.sum("times").alias("links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("bests"), F.sum(F.col("times") * F.col("n")).alias("total"))
    found = rows.drop("keys").join(sums, "row", "left")
    given = {"n_best": "bests", "count_sum": "total"}
    return found.select("doc_id", *(F.coalesce(given.get(c, c), F.lit(0)).alias(c) for c in _NAMES), "groups_sha256")


def alignment_digests(docs: DataFrame, pair: Pair, id_col: str = "doc_id", text_col: str = "text", map_pairs: int = MAP_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every document."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    sc = spark.sparkContext
    shared = sc.broadcast(pair)
    texts = ids_and_text(docs, id_col, text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()
    path = scratch(spark, "ids")
    texts.mapInArrow(partial(_encoded, pair=shared), f"doc_id {kind}, a binary, b binary").write.parquet(path)
    encoded = spark.read.schema(f"doc_id {kind}, a binary, b binary").parquet(path)
    counts = pair_counts(encoded, shared)
    # The highest count of each A id: as many rows as A's vocabulary has.
    highest = counts.groupBy(F.shiftright("key", _SHIFT).alias("a")).agg(F.max("n").alias("n")).toArrow()
    best = np.zeros(_tokenizers(pair).a_size.size, np.int64)
    best[highest.column("a").to_numpy()] = highest.column("n").to_numpy()
    best_shared = sc.broadcast(best)
    if counts.count() > map_pairs:
        return _joined(encoded, counts, shared, best_shared, kind)
    files = counts.inputFiles()
    for f in files:
        sc.addFile(f)
    looked_up = partial(_looked_up, pair=shared, best=best_shared, files=[f.rsplit("/", 1)[-1] for f in files])
    return encoded.mapInArrow(looked_up, _DIGESTS.format(kind=kind))


def alignments(docs: DataFrame, pair: Pair, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, groups): the ids of both sides of each document's groups, array of (a, b); null without tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(pair)

    @F.arrow_udf("array<struct<a:array<int>,b:array<int>>>")
    def groups(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = _tokenizers(shared.value)
        for texts in batches:
            out = []
            for text in texts:
                found = t.encode(text.as_py()) if text.is_valid and len(text.as_buffer()) else None
                if found is None:
                    out.append(None)
                    continue
                a, b = (np.frombuffer(x, k).astype(np.int64) for x, k in zip(found, t.kinds, strict=True))
                own = Links([a], [b], t)
                sides = (np.split(x, np.flatnonzero(np.diff(g)) + 1) for x, g in ((a, own.a_group), (b, own.b_group)))
                out.append([{"a": x.tolist(), "b": y.tolist()} for x, y in zip(*sides, strict=True)])
            yield pa.array(out, pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])))

    return ids_and_text(docs, id_col, text_col).select("doc_id", groups("text").alias("groups"))
