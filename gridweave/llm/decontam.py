"""Benchmark decontamination (operator 7).

The normalised word windows of the test items form a hash set that is broadcast; every
training text is scanned once.  Words are hashed, every window of a text gets a hash from
its words' with numpy, a hash that is marked is looked up in the sorted hashes of the set,
and what is found is verified by the words themselves.

The set is broadcast up to SET_WINDOWS windows (some 40 bytes each).  Of a larger benchmark
only a bitmap is, made in slices by Spark, of 2 bytes a window and MARK_BITS bits at most:
windows of the documents that it marks are joined with the table of test windows by hash and
words, and what hits goes back to the documents by the hash and length of their texts.

Defined cases: null and wordless texts have no words and no hits; an item without words
has no window; an item with fewer words than a window is one window; repeated items count
once; items without an id count as one item together, hit like any other, and are left out
of the ids.  Empty tables give empty results, an empty item set gives no hits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import cut, ids_and_text, sized, strings, utf8

WINDOW = 10
SET_WINDOWS = 1 << 20
MARK_BITS = 29
_SLICES = 64
_WORD = bytes(x if x >= 0x80 or 0x30 <= x <= 0x39 or 0x61 <= x <= 0x7A else x + 32 if 0x41 <= x <= 0x5A else 0x20 for x in range(256))
_IN_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BASE = 0x9E3779B97F4A7C15
HITS = "array<struct<start:int,end:int>>"
SPANS = f"struct<hits:{HITS},items:array<string>,n_words:int>"
_HITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD).split() if text else []


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each window of `size` neighbouring words."""
    n = len(hashes) - size + 1
    total = np.full(max(0, n), size, np.uint64)
    for i in range(size if n > 0 else 0):
        total = (total ^ hashes[i : n + i]) * np.uint64(_BASE)
        total ^= total >> np.uint64(32)
    return total


class WindowSet:
    """Windows of the items: for each size the sorted hashes, which item and where in it each is, and the items' words."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int = WINDOW):
        self.names = [name for name, _ in items]
        self.texts: list[bytes] = []
        self.ends: list[np.ndarray] = []
        found: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for number, (_, text) in enumerate(items):
            tokens = words(text)
            self.texts.append(b" ".join(tokens))
            self.ends.append(np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1, dtype=np.int64) - 1)
            if size := min(window, len(tokens)):
                hashes = window_hashes(word_hashes(tokens), size)
                found.setdefault(size, []).append((hashes, np.full(len(hashes), number, np.int32), np.arange(len(hashes), dtype=np.int32)))
        self.sizes = []
        for size, parts in sorted(found.items()):
            hashes, item, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(hashes, kind="stable")
            hashes = hashes[order]
            bits = max(16, (8 * len(hashes)).bit_length())
            marked = np.zeros(1 << bits, bool)
            marked[hashes >> np.uint64(64 - bits)] = True
            self.sizes.append((size, np.uint64(64 - bits), marked, hashes, item[order], place[order]))

    def _words_at(self, item: int, place: int, size: int) -> bytes:
        ends = self.ends[item]
        return self.texts[item][ends[place - 1] + 1 if place else 0 : ends[place + size - 1]]

    def scan(self, text: bytes | None) -> tuple[list[tuple[int, int]], set[str | None], int]:
        """Word spans covered by occurring windows (merged), the items, and the number of words."""
        tokens = words(text)
        hashes = word_hashes(tokens) if self.sizes else np.empty(0, np.uint64)
        spans: list[tuple[int, int]] = []
        items: set[str | None] = set()
        for size, shift, marked, known, item, place in self.sizes:
            own = window_hashes(hashes, size)
            at = np.flatnonzero(marked[own >> shift])
            first, last = (np.searchsorted(known, own[at], x).tolist() for x in ("left", "right"))
            for i, low, high in zip(at.tolist(), first, last, strict=True):
                if low < high:
                    here = b" ".join(tokens[i : i + size])
                    names = {self.names[item[k]] for k in range(low, high) if self._words_at(item[k], place[k], size) == here}
                    if names:
                        spans.append((i, i + size))
                        items |= names
        return merged(spans), items, len(tokens)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def _scanner(windows):
    @F.arrow_udf(SPANS)
    def scan(texts: pa.Array) -> pa.Array:
        out = []
        for text in utf8(texts):
            spans, items, n = windows.value.scan(text)
            out.append({"hits": [{"start": s, "end": e} for s, e in spans], "items": sorted(items, key=lambda x: (x is None, x)), "n_words": n})
        return pa.array(out, pa.struct([("hits", _HITS), ("items", pa.list_(pa.string())), ("n_words", pa.int32())]))

    return scan


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(size, hash, words, item) for every different window of the items."""

    def cut_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(strings(batch.column("item")), utf8(batch.column("text")), strict=True):
                tokens = words(text)
                if size := min(window, len(tokens)):
                    hashes = window_hashes(word_hashes(tokens), size).view(np.int64)
                    own = [b" ".join(tokens[i : i + size]) for i in range(len(hashes))]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), size, np.int32)), pa.array(hashes), pa.array(own, pa.binary()), pa.array([name] * len(own), pa.string())], ["size", "hash", "words", "item"])

    return items.mapInArrow(cut_items, "size int, hash long, words binary, item string").distinct()


def marks(windows: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of the windows' hashes, by their upper bits.  Its slices are made apart and have a fixed size together."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[int, np.ndarray] = {}
        for batch in batches:
            slots = batch.column("hash").to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits)
            parts = batch.column("slice").to_numpy(zero_copy_only=False)
            for part in np.unique(parts).tolist():
                own = slices.setdefault(part, np.zeros((1 << bits) // _SLICES, bool))
                own[slots[parts == part] % np.uint64(len(own))] = True
        for part, own in slices.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())], ["slice", "bits"])

    part = F.shiftrightunsigned("hash", 64 - _SLICES.bit_length() + 1).cast("int")
    out = np.zeros((1 << bits) // 8, np.uint8)
    wide = len(out) // _SLICES
    for row in windows.select("hash", part.alias("slice")).repartition(_SLICES, "slice").mapInArrow(made, "slice int, bits binary").toLocalIterator():
        out[row.slice * wide : (row.slice + 1) * wide] = np.frombuffer(row.bits, np.uint8)
    return out


def _marked(bitmap, bits: int, sizes: list[int]):
    """The windows of a text that the bitmap marks: start, size, hash and words of each."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32()), ("hash", pa.int64()), ("words", pa.binary())]))

    @F.arrow_udf("array<struct<start:int,size:int,hash:long,words:binary>>")
    def marked(texts: pa.Array) -> pa.Array:
        out = []
        for text in utf8(texts):
            tokens = words(text)
            hashes = word_hashes(tokens)
            found = []
            for size in sizes:
                own = window_hashes(hashes, size)
                slots = own >> np.uint64(64 - bits)
                at = np.flatnonzero((bitmap.value[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1)
                found += [{"start": i, "size": size, "hash": h, "words": b" ".join(tokens[i : i + size])} for i, h in zip(at.tolist(), own[at].view(np.int64).tolist(), strict=True)]
            out.append(found)
        return pa.array(out, kind)

    return marked


def n_words(texts: pa.Array) -> pa.Array:
    return pa.array((len(words(x)) for x in utf8(texts)), pa.int32())


def _merged_spans(hits: pa.Array) -> pa.Array:
    return pa.array(([{"start": s, "end": e} for s, e in merged([(x["start"], x["end"]) for x in h])] for h in strings(hits)), _HITS)


def _scan_by_join(docs: DataFrame, items: DataFrame, text: Column, into: str, window: int, n: int) -> DataFrame:
    windows = cut(item_windows(items, window))
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # `window` numbers at most
    bits = min(MARK_BITS, max(16, (16 * n).bit_length()))
    bitmap = docs.sparkSession.sparkContext.broadcast(marks(windows, bits))
    print_of = F.struct(F.xxhash64(text).alias("hash"), F.octet_length(text).alias("length"))
    found = docs.where(text.isNotNull()).select(print_of.alias("print"), F.explode(_marked(bitmap, bits, sizes)(text)).alias("w")).dropDuplicates(["print", "w"])
    hits = found.select("print", "w.*").join(windows, ["size", "hash", "words"])
    span = F.struct("start", (F.col("start") + F.col("size")).alias("end"))
    by_text = cut(hits.groupBy("print").agg(F.collect_set(span).alias("spans"), F.collect_set(F.struct("item")).alias("names")))
    row, own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.col("print")
    joined = docs.select(row.alias("r"), text.alias("text"), print_of.alias("own")).join(sized(by_text), F.col("own") == own, "left")
    items_of = F.transform(F.array_sort("names", lambda a, b: F.when(a["item"].eqNullSafe(b["item"]), 0).when(a["item"].isNull(), 1).when(b["item"].isNull(), -1).when(a["item"] < b["item"], -1).otherwise(1)), lambda x: x["item"])
    hits_of = F.arrow_udf(_merged_spans, HITS)(F.coalesce("spans", F.array().cast(HITS)))
    result = F.struct(hits_of.alias("hits"), F.coalesce(items_of, F.array().cast("array<string>")).alias("items"), F.arrow_udf(n_words, "int")("text").alias("n_words"))
    return joined.select("r.*", result.alias(into))


def scan(docs: DataFrame, benchmark: DataFrame, text: Column | str = "text", into: str = "scan", window: int = WINDOW, item_col: str = "item_id", item_text: str = "text", set_windows: int = SET_WINDOWS) -> DataFrame:
    """The documents with a column `into`: hit word spans, item ids (sorted as strings, then null for items without one), number of words."""
    text = F.col(text) if isinstance(text, str) else text
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{item_text}`").alias("text")).where("text is not null")
    n, size = items.agg(F.sum(F.regexp_count("text", F.lit(_IN_WORD))), F.sum(F.octet_length("text"))).first()
    # No item has more windows than words, nor a text of a set more bytes than SET_WINDOWS words of usual length.
    if (n or 0) <= set_windows and (size or 0) <= 32 * set_windows:
        own = WindowSet([(r.item, r.text.encode()) for r in items.collect()], window)
        return docs.withColumn(into, _scanner(docs.sparkSession.sparkContext.broadcast(own))(text))
    return _scan_by_join(docs, items, text, into, window, n)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items, contaminated."""
    found = scan(ids_and_text(docs, id_col, text_col), benchmark, **options)
    hit = F.aggregate("scan.hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select("doc_id", F.col("scan.n_words").cast("long").alias("n_words"), hit.alias("n_hit"), F.size("scan.items").cast("long").alias("n_items"), F.array_compact("scan.items").alias("items")).withColumn("contaminated", F.col("n_hit") > 0)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove: str = "documents", **options) -> DataFrame:
    """The documents without test passages: contaminated documents go, or (remove="spans") only
    the words hit, with the rest of the text kept byte for byte."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    # Packed, so that no column can clash.
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("r"))
    text = F.col("r").getField(text_col)
    found = scan(packed, benchmark, text=text, into="scan", **options)
    if remove == "documents":
        return found.where(F.size("scan.hits") == 0).select("r.*")
    shorter = F.when(F.size("scan.hits") == 0, text).otherwise(F.arrow_udf(_cut_words, "string")(text, F.col("scan.hits")))
    return found.select(F.col("r").withField(f"`{text_col}`", shorter).alias("r")).select("r.*")


def _cut_words(texts: pa.Array, hits: pa.Array) -> pa.Array:
    return pa.array([without(t, [(x["start"], x["end"]) for x in h or []]) for t, h in zip(utf8(texts), hits.to_pylist(), strict=True)], pa.string())


def without(text: bytes | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the given word spans."""
    if not text or not spans:
        return None if text is None else text.decode()
    place = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(_WORD))]
    out, last = [], 0
    for s, e in spans:
        out.append(text[last : place[s][0]])
        last = place[e - 1][1]
    return b"".join([*out, text[last:]]).decode()


def digest(items: Column) -> Column:
    """SHA-256 of the item ids, comma-joined."""
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)


def digest_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
