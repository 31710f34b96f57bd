"""Bottom-k sketches of documents (operator 6), in DataFrame functions only.

A document's sketch is the K smallest distinct hashes of its word shingles, in order.
Sketches of parts merge into the sketch of the whole: keep the K smallest of the union.
From two sketches follow estimates of resemblance (share of the merged sketch that both
hold) and containment, from one the number of distinct shingles.  A sketch of fewer than K
hashes holds them all, and its estimates are exact.

Everything is a row-wise expression; no step explodes shingles or shuffles texts for them.

Defined cases: null counts as empty; a text without words has the empty sketch; fewer words
than a shingle are one shingle.  Two empty sketches resemble each other fully, an empty one
resembles no other.  Rows of one id follow each other in the order of their texts, repeated
rows too; rows without an id come last (see `neighbours`); an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.common import cut, ids_and_text

K = 128
SHINGLE = 5
#: About how many rows a range of ids has, unless there would be more than MAX_RANGES; QUANTILES cut the ids first.
RANGE_ROWS = 1000
MAX_RANGES = 1 << 18
QUANTILES = 512


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """Distinct hashes of the word shingles of a text: chained 64-bit hashes of lower-cased words."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")

    def hashed(words: Column) -> Column:
        spans = F.sequence(F.lit(0), F.size(words) - size)
        whole = F.array(F.aggregate(words, F.lit(42).cast("long"), lambda h, w: F.xxhash64(h, w)))
        return F.when(F.size(words) >= size, F.transform(spans, lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(size))))).when(F.size(words) > 0, whole).otherwise(F.array().cast("array<long>"))

    # A one-element array binds the words, so that they are split once.
    return F.array_distinct(F.element_at(F.transform(F.array(words), hashed), 1))


def sketch(text: Column, k: int = K, size: int = SHINGLE) -> Column:
    """The bottom-k sketch of a text: at most k distinct hashes, ascending."""
    return F.slice(F.sort_array(shingle_hashes(text, size)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the shingle sets behind two sketches."""
    both = merged(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(a, b), both))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / F.size(both))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    span = (F.element_at(a, -1).cast("double") - float(-(1 << 63))) / float(1 << 64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / span)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, too."""
    union = distinct_count(merged(a, b, k), k)
    share = resemblance(a, b, k) * union / distinct_count(a, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), share))


def as_text(a: Column) -> Column:
    """A sketch as hexadecimal digits, 16 for each hash."""
    return F.lower(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, size: int = SHINGLE) -> DataFrame:
    """(doc_id, sketch, n_distinct) of every document."""
    return ids_and_text(docs, id_col, text_col).select("doc_id", sketch(F.col("text"), k, size).alias("sketch")).withColumn("n_distinct", distinct_count(F.col("sketch"), k))


def _edges(ids: DataFrame, rows: int) -> tuple[list[int], int]:
    """Quantiles of the ids, with the least and one past the greatest, and into how many equal
    parts each stretch between two of them is cut, so that a range has about `rows` rows."""
    n, low, high = ids.agg(F.count("*"), F.min("key"), F.max("key")).first()
    if not n:
        return [0, 1], 1
    ranges = min(MAX_RANGES, -(-n // rows))
    quantiles = min(QUANTILES, ranges)
    at = [i / quantiles for i in range(1, quantiles)]
    inner = ids.agg(F.percentile_approx("key", at, 20 * QUANTILES)).first()[0] if at else []
    return sorted({low, high + 1, *inner}), -(-ranges // quantiles)


def _range_of(key: Column, edges: list[int], pieces: int) -> Column:
    """The number of the range: the stretch between two edges is found in two steps, then the piece within it."""
    step = max(1, int(len(edges) ** 0.5))
    groups = [edges[i : i + step] for i in range(0, len(edges), step)]
    longs = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    group = F.size(F.filter(longs([g[0] for g in groups]), lambda x: x <= key)) - 1
    stretch = group * step + F.size(F.filter(F.get(F.array(*map(longs, groups)), group), lambda x: x <= key)) - 1
    if pieces == 1:
        return stretch
    low, high = F.get(longs(edges), stretch), F.get(longs(edges), stretch + 1)
    # In doubles: differences and products of longs overflow.  Rounding keeps the order of keys, but could reach the next stretch.
    share = (key.cast("double") - low.cast("double")) / (high.cast("double") - low.cast("double"))
    return stretch * pieces + F.greatest(F.lit(0), F.least(F.lit(pieces - 1), F.floor(share * pieces).cast("int")))


def _part_of(late: Column, key: Column, edges: list[int], pieces: int, late_pieces: int) -> Column:
    """The number of a row's range: rows without an id have theirs after all others, equal stretches of the hash."""
    share = (key.cast("double") + float(1 << 63)) / float(1 << 64)
    piece = F.least(F.lit(max(0, late_pieces - 1)), F.floor(share * late_pieces).cast("int"))
    return F.when(late, F.lit(len(edges) * pieces) + piece).otherwise(_range_of(key, edges, pieces))


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, size: int = SHINGLE, rows: int = RANGE_ROWS) -> DataFrame:
    """Each document with its sketch, its edited text and that text's sketch, and the next document's sketch.

    The next document is the one with the next higher id, and the first one after the last.
    The edited text has the last floor(n/2) of n code points replaced by the next document's
    first as many, or all.  Texts are shuffled once, by id range; the first document of each
    range also goes to the range before it.  Rows without an id come last, in the order of
    their texts' hashes and in ranges of their own.
    """
    own = ids_and_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    late, key = F.col("doc_id").isNull(), F.coalesce("doc_id", F.xxhash64("text"))
    ids = cut(own.select(late.alias("late"), key.alias("key")))
    edges, pieces = _edges(ids.where("not late"), rows)
    n_late = ids.where("late").count()
    part = _part_of(F.col("late"), F.col("key"), edges, pieces, min(MAX_RANGES, -(-n_late // rows)))
    every = Window.partitionBy()
    heads = ids.groupBy(part.alias("own_part")).agg(F.min("key").alias("head"))  # a row for each range
    heads = heads.select("own_part", "head", F.coalesce(F.lag("own_part").over(Window.orderBy("own_part")), F.max("own_part").over(every)).alias("before"))
    keyed = own.withColumn("late", late).withColumn("key", key).withColumn("part", part)
    # The ranges' number is bounded by twice MAX_RANGES, so their heads can be broadcast.
    seen = keyed.join(F.broadcast(heads), (F.col("part") == F.col("own_part")) & (F.col("key") == F.col("head")), "left")
    both = F.array(F.struct("part", F.lit(False).alias("guest")), F.struct(F.col("before").alias("part"), F.lit(True).alias("guest")))
    dealt = seen.select("doc_id", "text", "key", F.inline(F.when(F.col("before").isNull(), F.slice(both, 1, 1)).otherwise(both)))
    order = Window.partitionBy("part").orderBy("guest", "key", "text")
    half = F.floor(F.length("text") / 2).cast("int")
    paired = dealt.withColumn("next", F.coalesce(F.lead("text").over(order), F.lit("")))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next"), F.lit(1), half))
    made = paired.select("doc_id", "part", "guest", "key", "text", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), sketch(F.col("text"), k, size).alias("sketch"))
    with_next = made.withColumn("next_sketch", F.coalesce(F.lead("sketch").over(order), F.array().cast("array<long>"))).where("not guest")
    return with_next.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "sketch", sketch(F.col("edited"), k, size).alias("edited_sketch"), "next_sketch")
