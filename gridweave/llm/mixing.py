"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (operator 12).

A source's target is its weight's share of all words asked for, at most `most` times its own
words; what that leaves is shared again by weight among the others.  A source is a stream of
words, its documents in the order of a hash, cut into blocks of BLOCK_WORDS; a document may
lie in several.  Each pass over a source takes its blocks in another random order, and the
last block taken is cut where the target is reached, so that a source gives its target to
the word, in `ceil(most)` passes at most.

Blocks are drawn for output shards by a tree: the root has the exact number of blocks of
each source; a node splits its numbers among its two halves of the shards by a multivariate
hypergeometric draw, source after source, so that each half gets exactly the blocks that it
has room for.  A leaf's numbers are intervals of each source's permuted blocks, disjoint from
other shards' by construction.  Within a shard what was drawn is put in random order.

A draw is an inverse distribution function, summed outwards from the mode, and works on the
numbers alone: nodes x sources rows whatever the input.  Places in streams and orders of
blocks are running sums over the hash's cells and within each cell, so no task sees a whole
source.  Everything is a function of the rows and the seed: reruns agree.

Native: DataFrame functions only.  The driver reads the number of rows, the number of
sources and sums over all sources, one row a round of sharing; sources are told apart by
128 bits of hash.

Defined cases: a null text has no words; documents without words are never taken, and no
block has them.  Null is a source, after all others.  A null id is a value like any other;
of rows equal in id, source and text, which one gets the larger share doesn't show.  With no
words at all, targets are 0.  An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.common import cut, sized

WEIGHTS = (5, 2, 1)
#: Words wanted, as a share of all.
SHARE = 1.5
#: Times a source, and so a document, is taken at most.
MOST = 2
BLOCK_WORDS = 4096
SHARDS = 64
#: Rows to a cell of a stream, and cells of all streams, about.
CELL_ROWS = 256
MAX_CELL_BITS = 20
_EXPLODE = 4096
_SOURCE = ("k1", "k2")


@dataclass(frozen=True)
class Mix:
    """documents: (doc, doc_id, size, source_size, target); pieces: (doc, shard, pass, first_word, words), doc telling rows apart."""

    documents: DataFrame
    pieces: DataFrame


WORD = r"[^\x20\x09-\x0D]++"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def starts(rows: DataFrame, key: tuple[str, ...], order: tuple[str, ...], size: str, count: int) -> DataFrame:
    """The rows with `start`: the sum of `size` over the rows of the same key that come before.

    The first column of the order is a hash, the others make it whole.  Sums are taken over
    the hash's cells first, then within each.
    """
    bits = min(MAX_CELL_BITS, max(0, count // CELL_ROWS).bit_length())
    celled = rows.withColumn("cell", F.shiftrightunsigned(order[0], 64 - bits).cast("int") if bits else F.lit(0))
    within = Window.partitionBy(*key, "cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = celled.groupBy(*key, "cell").agg(F.sum(size).alias("cell_size"))
    across = Window.partitionBy(*key).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*key, "cell", F.coalesce(F.sum("cell_size").over(across), F.lit(0)).alias("cell_start"))
    inner = celled.withColumn("start", F.coalesce(F.sum(size).over(within), F.lit(0)))
    return inner.join(before, [*key, "cell"]).withColumn("start", F.col("start") + F.col("cell_start")).drop("cell", "cell_start")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The sources (source, source_size) with weight and target, double."""
    # Ranks without a window over all: numbers within sorted partitions plus those before.
    parted = cut(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    part, number = F.shiftrightunsigned("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = parted.groupBy(part.alias("part")).count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = sizes.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    weight = reduce(lambda a, iw: a.when(F.col("rank") % len(weights) == iw[0], iw[1]), enumerate(weights), F.when(F.lit(False), 0))
    ranked = cut(parted.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", F.col("offset") + number).withColumn("weight", weight).drop("part", "offset", "at", "rank"))
    asked = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = 0.0, F.col("source_size") * most
    while True:
        is_full = full <= level * F.col("weight")
        held, free = ranked.agg(F.sum(F.when(is_full, full).otherwise(0)), F.sum(F.when(is_full, 0).otherwise(F.col("weight")))).first()
        above = (asked - (held or 0)) / free if free else level
        if above <= level:
            return ranked.withColumn("target", F.least(full.cast("double"), F.lit(level) * F.col("weight")))
        level = above


def _log_factorial(n: Column) -> Column:
    """ln n!, from 16 on by Stirling's series."""
    z = n.cast("double") + 1
    series = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, 5))
    return F.when(n < 16, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def _bound(value: Column, then) -> Column:
    """An expression of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """How many good ones are among `draws` of `total`, for a uniform number u in [0, 1).

    Probabilities are summed outwards from the mode, each from its neighbour, until they
    pass u; beyond eight deviations nothing is left that a double could tell.
    """
    lf = _log_factorial
    zero = F.lit(0).cast("long")
    least, most = F.greatest(zero, draws - (total - good)), F.least(good, draws)
    t, g, d = (x.cast("double") for x in (total, good, draws))
    mode = F.least(most, F.greatest(least, F.floor((d + 1) * (g + 1) / (t + 2)).cast("long")))
    deviation = F.sqrt(F.greatest(F.lit(0.0), d * (g / t) * (1 - g / t) * (t - d) / F.greatest(F.lit(1.0), t - 1)))
    steps = F.least(F.ceil(deviation * 8).cast("long") + 16, most - least)

    def drawn(m: Column) -> Column:
        log_p = lf(good) - lf(m) - lf(good - m) + lf(total - good) - lf(draws - m) - lf(total - good - draws + m) - (lf(total) - lf(draws) - lf(total - draws))

        def outwards(p: Column) -> Column:
            begin = F.struct((u - p).alias("rest"), p.alias("up"), p.alias("down"), F.when(u < p, m).alias("found"))

            def step(a: Column, i: Column) -> Column:
                high, low = (m + i).cast("double"), (m - i).cast("double")
                up = a["up"] * (g - high + 1) * (d - high + 1) / (high * (t - g - d + high))
                down = a["down"] * (low + 1) * (t - g - d + low + 1) / ((g - low) * (d - low))
                both = F.struct(F.greatest(up, F.lit(0.0)).alias("up"), F.greatest(down, F.lit(0.0)).alias("down"))
                found = lambda b: F.when(a["found"].isNotNull(), a["found"]).when(a["rest"] < b["up"], m + i).when(a["rest"] - b["up"] < b["down"], m - i)
                return _bound(both, lambda b: F.struct((a["rest"] - b["up"] - b["down"]).alias("rest"), b["up"].alias("up"), b["down"].alias("down"), found(b).alias("found")))

            return F.coalesce(F.aggregate(F.when(steps > 0, F.sequence(F.lit(1).cast("long"), steps)).otherwise(F.array().cast("array<bigint>")), begin, step, lambda a: a["found"]), m)

        return _bound(F.exp(log_p), outwards)

    return F.when(least == most, least).otherwise(_bound(mode, drawn))


def uniform(*values: Column) -> Column:
    """A number in [0, 1) that the values determine."""
    return F.shiftrightunsigned(F.xxhash64(*values), 11).cast("double") / float(1 << 53)


_SHARE = "struct<k1:bigint,k2:bigint,first:bigint,n:bigint>"


def splitting_tree(counts: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """(k1, k2, shard, first, n): which of each source's draws (k1, k2, n) a shard gets, those from `first` on.

    Each shard gets the same number of draws, or one more or less.
    """
    root = counts.agg(F.sort_array(F.collect_list(F.struct("k1", "k2", F.lit(0).cast("long").alias("first"), F.col("n").cast("long").alias("n")))).alias("shares"))
    total = F.aggregate("shares", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    nodes = root.select(F.lit(0).alias("low"), F.lit(shards).alias("high"), total.alias("all"), "shares")
    place = lambda shard: F.expr(f"cast({shard} as bigint) * `all` div {shards}")
    for level in range((shards - 1).bit_length()):
        middle = F.expr("(low + high) div 2")
        nodes = nodes.withColumn("middle", middle)
        room, own = place("middle") - place("low"), place("high") - place("low")

        def one(a: Column, x: Column) -> Column:
            u = uniform(F.lit(seed), F.col("low"), F.col("high"), x["k1"], x["k2"])
            return _bound(hypergeometric(a["left"], x["n"], a["room"], u), lambda n: F.struct((a["left"] - x["n"]).alias("left"), (a["room"] - n).alias("room"), F.concat(a["parts"], F.array(n)).alias("parts")))

        begin = F.struct(own.alias("left"), room.alias("room"), F.array().cast("array<bigint>").alias("parts"))
        nodes = nodes.withColumn("parts", F.when(F.col("high") - F.col("low") > 1, F.aggregate("shares", begin, one, lambda a: a["parts"])))
        some = lambda shares: F.filter(shares, lambda x: x["n"] > 0)
        first = F.transform("shares", lambda x, i: F.struct(x["k1"].alias("k1"), x["k2"].alias("k2"), x["first"].alias("first"), F.get("parts", i).alias("n")))
        second = F.transform("shares", lambda x, i: F.struct(x["k1"].alias("k1"), x["k2"].alias("k2"), (x["first"] + F.get("parts", i)).alias("first"), (x["n"] - F.get("parts", i)).alias("n")))
        node = lambda low, high, shares: F.struct(F.col(low).alias("low"), F.col(high).alias("high"), shares.cast(f"array<{_SHARE}>").alias("shares"))
        halves = F.when(F.col("parts").isNull(), F.array(node("low", "high", F.col("shares")))).otherwise(F.array(node("low", "middle", some(first)), node("middle", "high", some(second))))
        nodes = nodes.select("all", F.inline(halves)).select("low", "high", "all", "shares")
        if level % 8 == 7:  # few rows so far: the next levels' work is dealt out
            nodes = nodes.repartition("low")
    return nodes.select(F.col("low").alias("shard"), F.inline("shares")).select("k1", "k2", "shard", "first", "n")


def _counted(rows: DataFrame, n: str, name: str, keys: tuple[str, ...]) -> DataFrame:
    """Each row n times, numbered from 0; many numbers are made by many tasks."""
    steps = rows.where(F.col(n) > 0).withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(_EXPLODE).cast("long"))))
    dealt = steps.repartition(*keys, "from")
    return dealt.withColumn(name, F.explode(F.sequence("from", F.least(F.col("from") + _EXPLODE, F.col(n)) - 1))).drop("from")


def draws(sources: DataFrame, shards: int, block_words: int = BLOCK_WORDS, seed: int = 0) -> DataFrame:
    """(k1, k2, pass, block, words, shard): the blocks of sources (k1, k2, source_size, words_wanted), and how many words of each, that each shard gets."""
    size, wanted = F.col("source_size"), F.col("words_wanted")
    passes = sources.where((size > 0) & (wanted > 0)).select(*_SOURCE, "source_size", "words_wanted", F.expr(f"(source_size + {block_words} - 1) div {block_words}").alias("blocks"), F.explode(F.expr("sequence(0, cast((words_wanted - 1) div source_size as int))")).alias("pass"))
    passes = cut(passes)
    count = passes.agg(F.sum("blocks")).first()[0] or 0
    each = _counted(passes, "blocks", "block", (*_SOURCE, "pass"))
    each = each.withColumn("full", F.least(F.lit(block_words).cast("long"), size - F.col("block") * block_words)).withColumn("hash", F.xxhash64(F.lit(seed), *_SOURCE, "pass", "block"))
    placed = starts(each, (*_SOURCE, "pass"), ("hash", "block"), "full", count)
    words = F.least(F.col("full"), wanted - F.col("pass") * size - F.col("start"))
    # All blocks but one have block_words words, so the words before tell the number before.
    number = F.col("pass") * F.col("blocks") + F.expr(f"(start + {block_words} - 1) div {block_words}")
    taken = cut(placed.select(*_SOURCE, F.col("pass"), "block", words.alias("words"), number.alias("draw")).where("words > 0"))
    intervals = splitting_tree(taken.groupBy(*_SOURCE).agg(F.count("*").alias("n")), shards, seed)
    dealt = _counted(intervals, "n", "i", (*_SOURCE, "shard")).select(*_SOURCE, "shard", (F.col("first") + F.col("i")).alias("draw"))
    return taken.join(dealt, [*_SOURCE, "draw"]).drop("draw")


def mix(
    docs: DataFrame, shards: int = SHARDS, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block_words: int = BLOCK_WORDS, seed: int = 0,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> Mix:
    """The mix of all documents: `share` times their words, by sources' weights."""
    text, source = F.col(f"`{text_col}`"), F.col(f"`{source_col}`").cast("string")
    doc_id = F.col(f"`{id_col}`")
    named = docs.select(doc_id.alias("doc_id"), source.alias("source"), word_count(text).alias("size"), key_hash(doc_id, text, seed).alias("hash"))
    keyed = named.withColumn("k1", F.xxhash64(F.col("source").isNull(), "source")).withColumn("k2", F.xxhash64(F.lit(1), F.col("source").isNull(), "source"))
    # Equal rows are counted, then told apart by number.
    rows = cut(keyed.groupBy(*_SOURCE, "source", "hash", "doc_id", "size").agg(F.count("*").alias("copies")))
    count = rows.count()
    sizes = rows.groupBy(*_SOURCE, "source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    sources = cut(targets(sizes, weights, share, most).withColumn("words_wanted", F.round("target").cast("long")))
    taken = draws(sources, shards, block_words, seed)
    spans = rows.withColumn("span", F.col("size") * F.col("copies"))
    placed = starts(spans.select(*_SOURCE, "hash", "doc_id", "size", "copies", "span"), _SOURCE, ("hash", "doc_id", "size"), "span", count)
    copies = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("start", F.col("start") + F.col("copy") * F.col("size"))
    doc = F.struct(*_SOURCE, "hash", "doc_id", "copy")
    own = copies.select(*_SOURCE, doc.alias("doc"), "doc_id", "size", "start")
    b = block_words
    pieces = own.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {b}, (start + size - 1) div {b})")))
    low, high = F.greatest(F.col("start"), F.col("block") * b), F.least(F.col("start") + F.col("size"), F.col("block") * b + F.col("words"))
    drawn = pieces.join(taken, [*_SOURCE, "block"]).select("doc", "shard", "pass", (low - F.col("start")).alias("first_word"), (high - low).alias("words")).where("words > 0")
    known = own.join(sized(sources.select(*_SOURCE, "source_size", "target")), list(_SOURCE)).select("doc", "doc_id", "size", "source_size", "target")
    return Mix(known, drawn)


def key_hash(doc_id: Column, text: Column, seed: int = 0) -> Column:
    return F.xxhash64(F.lit(seed), doc_id, text)


def shuffled(pieces: DataFrame, seed: int = 0) -> DataFrame:
    """The pieces with `position`, their place in their shard: at random, from 0 on."""
    one = F.xxhash64(F.lit(seed), "shard", "pass", "doc", "first_word")
    order = Window.partitionBy("shard").orderBy(one, "doc", "pass", "first_word")
    return pieces.withColumn("position", F.row_number().over(order) - 1)


def taken_words(made: Mix) -> DataFrame:
    """(doc_id, size, source_size, target, taken, pieces, first_shard) for every document."""
    by_doc = made.pieces.groupBy("doc").agg(F.sum("words").alias("taken"), F.count("*").alias("pieces"), F.min("shard").alias("first_shard"))
    found = made.documents.join(by_doc, "doc", "left")
    return found.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("pieces", F.lit(0)).alias("pieces"), "first_shard")


def mixed_texts(docs: DataFrame, made: Mix, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(shard, position, doc_id, pass, text): the mix itself, each shard in random order.

    A document taken as a whole keeps its text; of one in several blocks a piece has its
    words with single spaces.  Write it partitioned by shard.
    """
    doc_id, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    texts = docs.select(key_hash(doc_id, text, seed).alias("hash"), doc_id.alias("doc_id"), text.alias("text")).groupBy("hash", "doc_id").agg(F.min("text").alias("text"))
    placed = shuffled(made.pieces, seed).select(F.col("doc.hash").alias("of"), F.col("doc.doc_id").alias("id"), F.struct("shard", "position", "pass", "first_word", "words").alias("piece"))
    by_doc = placed.groupBy("of", "id").agg(F.collect_list("piece").alias("pieces"))
    met = by_doc.join(texts, (F.col("of") == F.col("hash")) & F.col("id").eqNullSafe(F.col("doc_id")))

    def parts(words: Column) -> Column:
        """A document's pieces with their texts; the document is split into words once."""
        whole = lambda p: (p["first_word"] == 0) & (p["words"] == F.size(words))
        part = lambda p: F.array_join(F.slice(words, p["first_word"].cast("int") + 1, p["words"].cast("int")), " ")
        return F.transform("pieces", lambda p: F.struct(p["shard"].alias("shard"), p["position"].alias("position"), p["pass"].alias("pass"), F.when(whole(p), F.col("text")).otherwise(part(p)).alias("text")))

    cut_up = _bound(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), parts)
    return met.select("doc_id", F.explode(cut_up).alias("p")).select("p.shard", "p.position", "doc_id", "p.pass", "p.text")
