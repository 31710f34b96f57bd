"""SimHash near-duplicate groups (operator 2).

Fingerprints are linked when they differ in at most RADIUS bits.  With RADIUS + 1 bands of
equal width, two such fingerprints agree in one band at least, so only rows of one band
value are compared: rows are dealt by (band, value), ordered by population count and
compared tile against tile with numpy exclusive-or and bit counts.  Tile pairs whose
population counts differ by more than the radius are skipped.  Band values with many
fingerprints are cut into blocks by hash and each pair of blocks becomes a task group of
its own, so no group exceeds 2 * BLOCK rows and no pair is lost.  A tile pair returns a
spanning forest of its links, never the pairs themselves; connected components over those
links run as large-star / small-star rounds of joins and minima.

At a similarity of 0.8 fingerprints of 64 bits differ in ten bits on average and in twenty
at times; so wide a radius leaves bands of three bits, which deal nothing apart.  For that
case, similar_groups(), rows are dealt by MinHash bands of their shingle sets instead
(SET_BANDS of SET_ROWS minima: a pair at 0.8 shares none once in 70,000 pairs, one at 0.85
once in 10^7), the same tiles compare fingerprints of 256 bits within SET_RADIUS (a pair at
0.8 differs in 39 bits on average, with a deviation of 6), and the exact Jaccard similarity
of the sets confirms each link.  Equal sets are compared once, by digest.

Defined cases: null, empty and blank texts have no words, hence fingerprint zero, and link
like any other.  Repeated rows share a fingerprint.  Null ids are never the name of a group
unless the group has no other; similar_groups() leaves rows without an id out, and both
ways of deduplicating keep them.  Of several rows with one id one stays: that with the least
text, and of these the least as JSON.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.common import cut, ids_and_text, sized, utf8

SHINGLE = 3
RADIUS = 3
SEED = 42
BANDS = RADIUS + 1
TILE = 256
BLOCK = 1024
#: For groups by similarity of shingle sets.
SET_SHINGLE = 5
SIMILARITY = 0.8
SET_RADIUS = 66
SET_WORDS = ("fp0", "fp1", "fp2", "fp3")
SET_ROWS = 5
SET_BANDS = 28
#: How many shingles a block of texts that are confirmed together has.
BLOCK_SHINGLES = 1 << 20
_PIECE = 1 << 16
_SET_PIECE = 1 << 10
_RANDOM = np.random.default_rng(20240301)
_TURN = _RANDOM.integers(0, 1 << 32, (SET_ROWS * SET_BANDS, 1), np.uint32)
_TIMES = _RANDOM.integers(0, 1 << 32, (SET_ROWS * SET_BANDS, 1), np.uint32) | np.uint32(1)


def shingle_hashes(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; A-Z lower-cased, words split at ASCII white space."""
    words = text.lower().split() if text else []
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([digest(line)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - size].tolist()
    spans = map(line.__getitem__, map(slice, starts, ends[size - 1 :].tolist()))
    return np.fromiter(map(digest, spans), np.uint64, len(starts))


def simhash(text: bytes | None, size: int = SHINGLE) -> int:
    """The 64-bit fingerprint: a bit is set when it is set in over half the shingle hashes."""
    return majority(shingle_hashes(text, size))


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are set in over half the hashes; zero without any."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _PIECE):
        part = np.ascontiguousarray(hashes[at : at + _PIECE].astype("<u8")).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def wide_prints(hashes: np.ndarray) -> list[int]:
    """The fingerprint of a shingle set, signed 64-bit words: that of the hashes, and of the hashes mixed anew."""
    out = []
    for i in range(len(SET_WORDS)):
        if i:
            hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            hashes = hashes ^ (hashes >> np.uint64(32))
        found = majority(hashes)
        out.append(found - (1 << 64) if found >> 63 else found)
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The numbers of differing bits of each row of `a` and each of `b`; rows are fingerprints of some words."""
    out = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
    for i in range(1, a.shape[1]):
        out = out.astype(np.int16) + np.bitwise_count(a[:, None, i] ^ b[None, :, i])
    return out


def fingerprint(text: Column | str, size: int = SHINGLE) -> Column:
    """The fingerprint of a text column as a signed long."""

    @F.arrow_udf("long")
    def fingerprint_of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([simhash(x, size) for x in utf8(texts)], np.uint64).view(np.int64))

    return fingerprint_of(text)


def spanning_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 and links a-b: the smallest node that each can reach."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        low, high = np.minimum(x, y)[differ], np.maximum(x, y)[differ]
        np.minimum.at(label, high, low)
        while True:
            higher = label[label]
            if (higher == label).all():
                break
            label = higher


def tile_links(group: np.ndarray, ones: np.ndarray, prints: np.ndarray, radius: int = RADIUS, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Links (as a spanning forest of positions) among rows ordered by group and population count; a row of `prints` is a fingerprint."""
    n, left, right = len(prints), [], []
    for i in range(0, n, tile):
        here = slice(i, min(n, i + tile))
        low, high = ones[here].min(), ones[here].max()
        for j in range(i, n, tile):
            there = slice(j, min(n, j + tile))
            if group[j] != group[here.stop - 1] and j > i:
                break
            if int(ones[there].min()) - int(high) > radius or int(low) - int(ones[there].max()) > radius:
                continue
            near = distances(prints[here], prints[there]) <= radius
            r, c = np.nonzero(np.triu(near, 1) if i == j else near)
            if len(r):
                left.append(r + i)
                right.append(c + j)
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    label = spanning_labels(np.concatenate(left), np.concatenate(right), n)
    linked = np.flatnonzero(label != np.arange(n))
    return linked, label[linked]


def _compare(batches: Iterator[pa.RecordBatch], radius: int, words: tuple[str, ...], node: str) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by band, value, block pair and population count; a group may span batches.  Links are given by the column `node`."""
    keys = ("band", "value", "first", "second")
    kept: list[np.ndarray] | None = None

    def links(cols: list[np.ndarray], upto: int) -> pa.RecordBatch:
        # A row alone in its group has nothing to be compared with.
        group = cols[4][:upto]
        alone = np.ones(upto, bool)
        alone[1:] &= group[1:] != group[:-1]
        alone[:-1] &= group[1:] != group[:-1]
        group, ones, nodes, *prints = (x[:upto][~alone] for x in cols[4:])
        a, b = tile_links(group, ones, np.stack([x.view(np.uint64) for x in prints], axis=1), radius)
        return pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], ["a", "b"])

    for batch in batches:
        new = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new += [np.zeros(batch.num_rows, np.int64), *(batch.column(k).to_numpy(zero_copy_only=False) for k in ("ones", node, *words))]
        cols = [np.concatenate(x) for x in zip(kept, new, strict=True)] if kept else new
        if not len(cols[0]):
            continue
        fresh = np.zeros(len(cols[0]), bool)
        for k in cols[:4]:
            fresh[1:] |= k[1:] != k[:-1]
        cols[4] = np.cumsum(fresh)
        last = int(np.searchsorted(cols[4], cols[4][-1]))
        if last:
            yield links(cols, last)
        kept = [x[last:] for x in cols]
    if kept:
        yield links(kept, len(kept[0]))


def tiled(banded: DataFrame, radius: int, block: int, words: tuple[str, ...] = ("fp",), node: str = "fp") -> DataFrame:
    """(a, b) for rows (band, value, the words of a fingerprint, node): links enough to connect all rows of one band value within the radius."""
    # Small tables that are joined to frequent keys are written first: a join then deals both
    # sides anew and can split what a frequent key has.
    crowded = cut(banded.groupBy("band", "value").count().where(F.col("count") > 2 * block))
    names = list(dict.fromkeys([*words, node]))
    blocks = F.coalesce(F.ceil(F.col("count") / block), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64(node), F.col("blocks")).cast("int")
    ones = reduce(Column.__add__, map(F.bit_count, words))
    rows = (
        banded.join(crowded, ["band", "value"], "left")
        .select(*names, "band", "value", blocks.alias("blocks"))
        .select(*names, "band", "value", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select(*names, "band", "value", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), ones.alias("ones"))
    )
    dealt = rows.repartition("band", "value", "first", "second").sortWithinPartitions("band", "value", "first", "second", "ones")
    return dealt.mapInArrow(partial(_compare, radius=radius, words=words, node=node), "a long, b long")


def links(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(a, b) for distinct fingerprints in column `fp`: links enough to connect all within the radius."""
    bands, width = radius + 1, 64 // (radius + 1)
    mask = (1 << width) - 1
    values = [F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit(mask).cast("long")).alias("value")) for i in range(bands)]
    return tiled(prints.select("fp", F.inline(F.array(*values))), radius, block)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge list (a, b): root is the smallest node it reaches.

    Alternating large-star and small-star rounds; the edge list never grows, and each
    round is written to the shared folder.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        # Written first, so that the join deals both sides anew and can split the edges of a frequent node.
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.union(lowest).distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        state = now


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): the near-duplicate group of every document, named by its smallest id."""
    prints = cut(ids_and_text(docs, id_col, text_col).select("doc_id", fingerprint("text", shingle).alias("fp")))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    linked = roots.join(distinct, "fp")
    named = cut(linked.groupBy("root").agg(F.min("rep").alias("component_id")))
    moved = linked.join(named, "root").select("fp", "component_id")
    parts = cut(distinct.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id")))
    return prints.join(parts, "fp").select("doc_id", "fp", "component_id")


def _one_of_each(docs: DataFrame, ids: DataFrame, parts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents whose id names its group, once each, and those without an id.  parts: (doc_id, component_id) for each row."""
    by_id = ids.groupBy("doc_id").agg(F.count("*").alias("n"))
    named = parts.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("names"))
    gone = cut(named.where("not names").select(F.col("doc_id").alias(id_col)))
    several = cut(by_id.where("n > 1 and doc_id is not null").select(F.col("doc_id").alias(id_col)))
    left = docs.join(sized(gone), id_col, "left_anti")
    if several.isEmpty():
        return left.select(docs.columns)
    order = Window.partitionBy("r.own").orderBy("r.text", "r.whole")
    row = F.struct(F.col(f"`{id_col}`").alias("own"), F.col(f"`{text_col}`").alias("text"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias("whole"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("all"))
    first = left.join(sized(several), id_col, "left_semi").select(row.alias("r")).withColumn("n", F.row_number().over(order)).where("n = 1").select("r.all.*")
    return left.join(sized(several), id_col, "left_anti").select(docs.columns).union(first)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The documents with one of each group left: that with the smallest id, once.

    Documents without an id can't be named by a group and stay.
    """
    found = cut(groups(docs, id_col, text_col, shingle, radius).select("doc_id", "component_id"))
    return _one_of_each(docs, found, found, id_col, text_col)


# -- groups by similarity of shingle sets


def set_bands(hashes: np.ndarray) -> np.ndarray:
    """A signed 64-bit number for each band of the MinHash signature of a set; none for an empty set."""
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(SET_ROWS * SET_BANDS, 0xFFFFFFFF, np.uint32)
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(low), _SET_PIECE):
        np.minimum(least, ((low[at : at + _SET_PIECE] ^ _TURN) * _TIMES).min(axis=1), out=least)
    raw, wide = least.astype("<u4").tobytes(), 4 * SET_ROWS
    return np.array([xxhash.xxh3_64_intdigest(raw[i * wide : (i + 1) * wide], i) for i in range(SET_BANDS)], np.uint64).view(np.int64)


def set_hashes(text: bytes | None, size: int = SET_SHINGLE) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def set_key(hashes: np.ndarray) -> int:
    """The digest of a shingle set, signed."""
    found = xxhash.xxh3_64_intdigest(hashes.astype("<u8").tobytes())
    return found - (1 << 64) if found >> 63 else found


def set_prints(text: Column | str, size: int = SET_SHINGLE) -> Column:
    """The digest of a text's shingle set, its size, its fingerprint and its bands."""
    words = ",".join(f"{x}:long" for x in SET_WORDS)

    @F.arrow_udf(f"struct<key:long,n:int,{words},bands:array<long>>")
    def prints_of(texts: pa.Array) -> pa.Array:
        rows = []
        for x in utf8(texts):
            hashes = set_hashes(x, size)
            rows.append((set_key(hashes), len(hashes), *wide_prints(hashes), set_bands(hashes)))
        columns = list(zip(*rows, strict=True)) or [()] * (3 + len(SET_WORDS))
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * len(SET_WORDS), pa.list_(pa.int64())]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "n", *SET_WORDS, "bands"])

    return prints_of(text)


def similar_links(sets: list[np.ndarray], prints: np.ndarray, similarity: float = SIMILARITY, radius: int = SET_RADIUS, tile: int = TILE) -> list[tuple[int, int]]:
    """Links that connect whatever pairs of the similarity or more and within the radius connect, and nothing else."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    label = np.arange(n)
    out = []
    order = np.argsort(sizes, kind="stable")
    for i in range(0, n, tile):
        here = order[i : i + tile]
        for j in range(i, n, tile):
            there = order[j : j + tile]
            # Rows come by size: beyond this tile none is small enough.
            if sizes[here[-1]] < similarity * sizes[there[0]]:
                break
            near = distances(prints[here], prints[there]) <= radius
            near &= sizes[here, None] >= similarity * sizes[None, there]
            near &= label[here, None] != label[None, there]
            for r in np.flatnonzero(near.any(axis=1)).tolist():
                x = int(here[r])
                for c in np.flatnonzero(near[r]).tolist():
                    y = int(there[c])
                    if label[x] == label[y] or x == y:
                        continue
                    shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    whole = sizes[x] + sizes[y] - shared
                    if shared >= similarity * whole:
                        out.append((x, y))
                        label[label == label[y]] = label[x]
    return out


def _confirm(batches: Iterator[pa.RecordBatch], size: int, similarity: float, radius: int) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by root and block pair; a group may span batches."""
    group, keys, sets, prints = None, [], [], []

    def out() -> pa.RecordBatch:
        found = similar_links(sets, np.array(prints, np.int64).view(np.uint64), similarity, radius)
        return pa.RecordBatch.from_arrays([pa.array([keys[e[i]] for e in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        names = zip(*(batch.column(k).to_pylist() for k in ("root", "first", "second")), strict=True)
        for i, name in enumerate(names):
            if name != group:
                if len(keys) > 1:
                    yield out()
                group, keys, sets, prints = name, [], [], []
            hashes = set_hashes(batch.column("text")[i].as_buffer().to_pybytes(), size)
            keys.append(batch.column("key")[i].as_py())
            prints.append(wide_prints(hashes))
            sets.append(hashes)
    if len(keys) > 1:
        yield out()


def confirmed(texts: DataFrame, size: int, similarity: float, radius: int, block_shingles: int) -> DataFrame:
    """(a, b) for candidates (root, key, n, text), each key once: links enough to connect all similar ones of a root.

    Roots with many shingles are cut into blocks by hash, and each pair of blocks becomes a
    task group of its own.
    """
    crowded = cut(texts.groupBy("root").agg(F.ceil(F.sum("n") / block_shingles).cast("int").alias("blocks")).where("blocks > 1"))
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    # With more than one block each pair of different blocks compares its own rows, too.
    other = F.when(F.col("blocks") > 1, F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: i != F.col("own"))).otherwise(F.array(F.lit(0)))
    rows = (
        texts.join(crowded, "root", "left")
        .select("root", "key", "text", F.coalesce("blocks", F.lit(1)).alias("blocks"))
        .withColumn("own", own)
        .select("root", "key", "text", "own", F.explode(other).alias("other"))
        .select("root", "key", "text", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"))
    )
    dealt = rows.repartition("root", "first", "second").sortWithinPartitions("root", "first", "second")
    return dealt.mapInArrow(partial(_confirm, size=size, similarity=similarity, radius=radius), "a long, b long")


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SET_SHINGLE, similarity: float = SIMILARITY, radius: int = SET_RADIUS, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES
) -> DataFrame:
    """(doc_id, component_id): the group of every row with an id: connected by pairs whose shingle
    sets have the Jaccard similarity or more, named by its smallest id."""
    rows = ids_and_text(docs, id_col, text_col).where("doc_id is not null")
    printed = cut(rows.select("doc_id", set_prints("text", shingle).alias("p")).select("doc_id", "p.*"))
    distinct = cut(printed.groupBy("key").agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("n", *SET_WORDS, "bands"))))
    banded = distinct.select("key", F.explode("bands").alias("value"))
    # A band value of a single set links nothing.
    shared = cut(banded.groupBy("value").count().where("count > 1").select("value"))
    met = cut(banded.join(shared, "value")).join(distinct.select("key", *SET_WORDS), "key").select(F.lit(0).alias("band"), "value", "key", *SET_WORDS)
    candidates = components(tiled(met, radius, block, SET_WORDS, "key")).withColumnRenamed("node", "key")
    chosen = cut(candidates.join(distinct.select("key", "rep", "n"), "key").select("root", F.col("key").alias("wanted"), "n", F.col("rep").alias("doc_id")))
    # Only candidates' texts are read again.  A repeated id may stand for several: the digest says which is meant.
    key_of = F.arrow_udf(lambda texts: pa.array([set_key(set_hashes(x, shingle)) for x in utf8(texts)], pa.int64()), "long")
    held = rows.join(sized(chosen), "doc_id").withColumn("key", key_of("text"))
    texts = cut(held.where("key = wanted").select("root", "key", "n", "text").dropDuplicates(["key"]))
    found = components(confirmed(texts, shingle, similarity, radius, block_shingles)).withColumnRenamed("node", "key")
    linked = found.join(distinct.select("key", "rep"), "key")
    least = cut(linked.groupBy("root").agg(F.min("rep").alias("component_id")))
    moved = linked.join(least, "root").select("key", "component_id")
    parts = cut(distinct.join(moved, "key", "left").select("key", F.coalesce("component_id", "rep").alias("component_id")))
    return printed.select("doc_id", "key").join(parts, "key").select("doc_id", "component_id")


def deduplicate_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SET_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The documents with one of each group of similar ones left: that with the smallest id, once.  Documents without an id stay."""
    found = cut(similar_groups(docs, id_col, text_col, shingle, similarity))
    return _one_of_each(docs, found, found, id_col, text_col)
