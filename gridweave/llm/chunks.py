"""Repeated passages by content-defined chunking (operator 5).

A gear hash rolls over a text's bytes; a chunk ends where it is small, and after MAX_BYTES
without such a place.  The hash depends on the last 32 bytes only, so after an insertion the
same borders come back with the same content.  Chunks are deduplicated by digest: the
digests of WINDOW neighbouring chunks are taken together, of each two such windows the one
with the smaller digest is kept as a seed, and a seed that two documents have is repeated.

Equal texts are found first, by 128 bits of hash: each is one passage, and one of them
stands for all in what follows.  For the others seeds say where to look.  A repeated seed
aligns its document with the first document that has it (that one with the last); seeds of
one offset are one alignment.  The texts on either side of each alignment are then compared
character by character until they differ: MARGIN code points beyond the seeds at first, and
where they are still equal there, again with GROWTH times as many, as often as it takes.  A
passage is a stretch of MIN_WORDS whole words or more that both have.  So every passage is
one that a single other document has as a whole, as long as it is there, however its chunks
are cut, and digests may collide.  A passage of over 50 words has a seed inside with odds of
some 98.6 % or more.

Texts are cut twice rather than their seeds kept: hashing a text costs less than writing
them.  Digests are reduced to the first and the last document before they are shuffled, and
of texts only the parts around alignments go on.

Defined cases: null and empty texts have no chunks; repeats within one document alone
don't count; rows without an id take no part.  Rows of one id are one document: repeated
ones count once, and of different texts that with the least hash is the document's, the
others are left as they are.  A passage that lies within another of the same document is
left out.  A document is compared with the first documents of its seeds: where each part of
a passage is in another document of smaller id, parts are looked up there alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.common import cut, ids_and_text, sized, utf8

#: The mean number of bytes between borders.
MEAN_BYTES = 24
MAX_BYTES = 96
#: How many chunks a seed has.
WINDOW = 3
#: Passages of over 50 words have as many whole ones, even if both end words are cut.
MIN_WORDS = 49
#: How far beyond its seeds an alignment is compared at first, in code points, and how much farther each further time.
MARGIN = 512
GROWTH = 16
_ROWS = 200_000
_PIECE = 1 << 20
_MEMORY = 32
#: Between texts that are cut together, up to about so many bytes or code points of them at once.
_GAP = bytes(_MEMORY - 1)
_TOGETHER = 1 << 18
_LIMIT = np.uint32((1 << 32) // MEAN_BYTES)
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: One random number for each byte value, from a fixed seed.
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(data: np.ndarray, silent: np.ndarray | None = None) -> np.ndarray:
    """The rolling hash after each byte: the sum of the last 32 bytes' gears, each shifted by its age; `silent` bytes have none."""
    h = _GEAR[data]
    if silent is not None:
        h[silent] = 0
    shift = 1
    while shift < _MEMORY:
        older = h[:-shift] << np.uint32(shift)
        h[shift:] += older
        shift *= 2
    return h


class Laid:
    """Texts laid one after the other, with so many silent bytes between them that no hash reaches from one to the next."""

    def __init__(self, texts: list[bytes]):
        self.joined = _GAP.join(texts)
        self.data = np.frombuffer(self.joined, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.stops = np.cumsum(sizes + len(_GAP)) - len(_GAP)
        self.begins = self.stops - sizes
        self.silent = np.zeros(len(self.data), bool)
        self.silent[(self.stops[:-1, None] + np.arange(len(_GAP))).ravel()] = True

    def text_of(self, ends: np.ndarray) -> np.ndarray:
        """The number of the text in which each chunk ends."""
        return np.searchsorted(self.stops, ends)

    def starts_of(self, ends: np.ndarray) -> np.ndarray:
        """Where the chunks with these ends, all there are, start."""
        return np.maximum(self.begins[self.text_of(ends)], np.concatenate(([0], ends[:-1]))) if len(ends) else ends

    def borders(self) -> np.ndarray:
        """The chunk ends, the last of each text being its end."""
        is_end = np.zeros(len(self.data) + 1, bool)
        is_end[self.stops[self.stops > self.begins]] = True
        for at in range(0, len(self.data), _PIECE):
            lead = min(at, _MEMORY - 1)
            piece = slice(at - lead, at + _PIECE)
            h = gear(self.data[piece], self.silent[piece])[lead:]
            is_end[at + 1 : at + 1 + len(h)] |= (h < _LIMIT) & ~self.silent[at : at + _PIECE]
        ends = np.flatnonzero(is_end)
        # A stretch without a border is cut every MAX_BYTES from its start.
        starts = self.starts_of(ends)
        cuts = np.maximum(0, ends - starts - 1) // MAX_BYTES
        nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts) + 1
        return np.sort(np.concatenate([ends, np.repeat(starts, cuts) + MAX_BYTES * nth]))

    def chunks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of the text, digest, start and end (code points) of each chunk."""
        ends = self.borders()
        starts, text = self.starts_of(ends), self.text_of(ends)
        digests = map(xxhash.xxh3_64_intdigest, map(self.joined.__getitem__, map(slice, starts.tolist(), ends.tolist())))
        found = np.fromiter(digests, np.uint64, len(ends))
        begins = self.begins[text]
        if self.joined.isascii():  # a byte is a code point
            return text, found, starts - begins, ends - begins
        points = np.concatenate(([0], np.cumsum((self.data & 0xC0) != 0x80)))
        return text, found, points[starts] - points[begins], points[ends] - points[begins]

    def seeds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of the text, digest, start, end (code points) of the windows kept, and whether it is the text's first with its digest."""
        text, digests, starts, ends = self.chunks()
        at = np.arange(len(text))
        first_chunk, last_chunk = np.searchsorted(text, text), np.searchsorted(text, text, "right") - 1
        mixed = np.zeros(len(text), np.uint64)
        for i in range(WINDOW):
            nth = np.minimum(at + i, last_chunk)
            mixed = np.where(at + i <= last_chunk, mixed * np.uint64(_MIX[0]) + digests[nth], mixed)
        # A text of fewer chunks is one window.
        window = np.flatnonzero((at == first_chunk) | (at + WINDOW - 1 <= last_chunk))
        text, mixed = text[window], mixed[window]
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(_MIX[1])
        kept = np.zeros(len(text), bool)
        same, smaller = text[1:] == text[:-1], mixed[1:] < mixed[:-1]
        kept[1:] |= same & smaller
        kept[:-1] |= same & ~smaller
        beside = np.concatenate(([False], same, [False]))
        kept |= ~(beside[1:] | beside[:-1])
        window, text, found = window[kept], text[kept], mixed[kept]
        order = np.lexsort((found, text))
        first = np.zeros(len(text), bool)
        again = (text[order][1:] == text[order][:-1]) & (found[order][1:] == found[order][:-1])
        first[order[np.concatenate(([True], ~again))[: len(order)]]] = True
        return text, found, starts[window], ends[np.minimum(window + WINDOW - 1, last_chunk[window])], first


def borders(text: bytes) -> np.ndarray:
    """The chunk ends of a text, the last being its length."""
    return Laid([text]).borders()


def chunks(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digest, start and end (code points) of each chunk."""
    return Laid([text]).chunks()[1:]


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: list[tuple] = []
    ids: list[int] = []
    texts: list[bytes] = []
    rows = size = 0

    def cut_texts() -> int:
        text, *columns = Laid(texts).seeds()
        kept.append((np.array(ids, np.int64)[text], *columns))
        ids.clear()
        texts.clear()
        return len(text)

    def out() -> pa.RecordBatch:
        doc_id, digest, start, end, first = (np.concatenate(c) for c in zip(*kept, strict=True))
        kept.clear()
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc_id, digest.view(np.int64), start.astype(np.int32), end.astype(np.int32), first)], ["doc_id", "digest", "start", "end", "first"])

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True):
            if text:
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
                if size >= _TOGETHER:
                    rows, size = rows + cut_texts(), 0
                if rows >= _ROWS:
                    yield out()
                    rows = 0
    if texts:
        cut_texts()
    if kept:
        yield out()


def seed_rows(texts: DataFrame) -> DataFrame:
    """(doc_id, digest, start, end, first) for the seeds of every text."""
    return texts.mapInArrow(_cut_rows, "doc_id long, digest long, start int, end int, first boolean")


def one_text_each(texts: DataFrame) -> DataFrame:
    """The rows (doc_id, text) with one left of several that have the same id: of its texts that with the least hash."""
    by_id = texts.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.xxhash64("text")).alias("least"))
    several = cut(by_id.where("n > 1").select("doc_id", "least"))
    if several.isEmpty():
        return texts
    # A frequent id is reduced before it is shuffled.
    chosen = texts.join(sized(several), "doc_id").where(F.xxhash64("text") == F.col("least")).groupBy("doc_id").agg(F.min("text").alias("text"))
    return texts.join(sized(several), "doc_id", "left_anti").union(chosen)


def alignments(texts: DataFrame, later_only: bool = False) -> DataFrame:
    """(doc_id, other, shift, low, high): where a document has seeds of another one, `shift` code points further on."""
    rows = seed_rows(texts)
    lead = F.when(F.col("first"), F.col("doc_id"))
    seen = rows.groupBy("digest").agg(
        F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.min_by("start", lead).alias("first_start"), F.max_by("start", lead).alias("last_start")
    )
    # Written first, so that the join deals both sides anew and can split a frequent seed.
    repeated = cut(seen.where("first_doc <> last_doc"))
    met = rows.select("doc_id", "digest", "start", "end").join(repeated, "digest")
    is_first = F.col("doc_id") == F.col("first_doc")
    if later_only:
        met = met.where(~is_first)
    other = F.when(is_first, F.col("last_doc")).otherwise(F.col("first_doc"))
    shift = F.col("start") - F.when(is_first, F.col("last_start")).otherwise(F.col("first_start"))
    return met.select("doc_id", other.alias("other"), shift.alias("shift"), "start", "end").groupBy("doc_id", "other", "shift").agg(F.min("start").alias("low"), F.max("end").alias("high"))


def whole_words(text: np.ndarray, begin: int, end: int, at_start: bool, at_end: bool) -> tuple[int, int, int]:
    """First start, last end and number of the words that lie between two places of a text (code points).

    at_start, at_end: whether a word can begin with the text's first code point and end with its last.
    """
    around = text[max(0, begin - 1) : end + 1]
    blank = np.concatenate(([at_start] * (begin == 0), (around == 32) | ((around >= 9) & (around <= 13)), [at_end] * (end == len(text)))).astype(bool)
    starts = np.flatnonzero(blank[:-2] & ~blank[1:-1]) + begin
    ends = np.flatnonzero(~blank[1:-1] & blank[2:]) + begin + 1
    ends = ends[np.searchsorted(ends, starts[0], "right") :] if len(starts) else ends[:0]
    return (int(starts[0]), int(ends[-1]), len(ends)) if len(ends) else (0, 0, 0)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def common(pairs: list[tuple[str, str, bool, bool, bool, bool]], min_words: int) -> list[list[tuple[int, int, int]] | None]:
    """For each two texts, laid side by side, the stretches that are equal and have enough whole words: start, end, words.

    pairs: both texts, whether a word can begin and end with the first one, whether both go on
    before and after.  None for two with a stretch that reaches an end beyond which both go on.
    """
    sizes = np.array([min(len(p[0]), len(p[1])) for p in pairs])
    # All pairs are compared at once, with marks between that differ, so that no stretch reaches from one to the next.
    a, b = (_points(mark.join(p[k][:n] for p, n in zip(pairs, sizes.tolist(), strict=True))) for k, mark in ((0, "a"), (1, "b")))
    edges = np.flatnonzero(np.diff(np.concatenate(([0], a == b, [0]))))
    begin, end = edges[::2], edges[1::2]
    starts = np.cumsum(sizes + 1) - sizes - 1
    pair = np.searchsorted(starts, begin, "right") - 1
    begin, end = begin - starts[pair], end - starts[pair]
    more_before, more_after = (np.array([p[k] for p in pairs], bool) for k in (4, 5))
    ongoing = more_before[pair] & (begin == 0) | more_after[pair] & (end == sizes[pair])
    out: list[list[tuple[int, int, int]] | None] = [[] for _ in pairs]
    for i in pair[ongoing].tolist():
        out[i] = None
    long = np.flatnonzero(end - begin >= 2 * min_words - 1)
    for i, first, last in zip(pair[long].tolist(), begin[long].tolist(), end[long].tolist(), strict=True):
        if out[i] is not None:
            stretch = whole_words(_points(pairs[i][0]), first, last, *pairs[i][2:4])
            out[i] += [stretch] if stretch[2] >= min_words else []
    return out


def _together(sizes: list[int]) -> Iterator[slice]:
    """Neighbours of about _TOGETHER in all."""
    begin = size = 0
    for i, n in enumerate(sizes, 1):
        size += n
        if size >= _TOGETHER or i == len(sizes):
            yield slice(begin, i)
            begin, size = i, 0


_FOUND = "doc_id long, print long, start int, end int, n_words int, first_doc long, shift int, low int, high int"


def _verify(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """The passages of alignments; an alignment that has to be compared farther out gives itself, without words."""
    names = ("doc_id", "print", "other", "shift", "low", "high", "from")
    for batch in batches:
        out = []
        pairs = list(zip(*(batch.column(c).to_pylist() for c in ("own", "text", "begins", "ends", "before", "after")), strict=True))
        each = (found for some in _together([len(p[0]) for p in pairs]) for found in common(pairs[some], min_words))
        for (doc_id, print_, first, shift, low, high, at), found in zip(zip(*(batch.column(c).to_pylist() for c in names), strict=True), each, strict=True):
            if found is None:
                out.append((doc_id, print_, 0, 0, 0, first, shift, low, high))
            else:
                out += [(doc_id, print_, at + s, at + e, n, first, shift, low, high) for s, e, n in found]
        columns = list(zip(*out, strict=True)) or [()] * 9
        kinds = [pa.int64() if x.split()[1] == "long" else pa.int32() for x in _FOUND.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _FOUND.split(", ")])


def _compared(texts: DataFrame, aligned: DataFrame, margin: int, min_words: int) -> DataFrame:
    """_FOUND for alignments (doc_id, other, shift, low, high): the texts compared up to `margin` beyond the seeds."""
    begin = F.greatest(F.lit(0), F.col("low") - margin, F.col("shift"))
    aligned = aligned.select("doc_id", "other", "shift", "low", "high", begin.alias("from"), (F.col("high") + margin).alias("to"))
    # Each alignment takes its part of both texts.
    side = lambda own, start: F.struct(F.lit(own).alias("own"), F.col("doc_id" if own else "other").alias("id"), start.alias("at"))
    asked = aligned.withColumn("side", F.explode(F.array(side(True, F.col("from")), side(False, F.col("from") - F.col("shift")))))
    ids = cut(asked.select(F.col("side.id").alias("doc_id")).distinct())
    # What is known of a text as a whole is found once for each text, and a text is gone through once for each part: to that and a code point on either side.
    held = texts.join(sized(ids), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("print"), F.length("text").alias("points"))
    at = F.col("side.at")
    around = F.substring(F.col("text"), F.greatest(at, F.lit(1)), F.col("to") - F.col("from") + 1 + F.least(F.lit(1), at))
    key = ["doc_id", "other", "shift"]
    taken = asked.join(held, F.col("side.id") == F.col("id")).select(*key, "low", "high", "from", "to", "side.own", "print", "points", F.col("side.at").alias("at"), around.alias("around"))
    # Whether the code point on either side of a part is blank or missing.
    led, size = F.least(F.lit(1), F.col("at")), F.col("to") - F.col("from")
    blank = lambda place: F.substring(F.col("around"), place, F.lit(1)).isin([" ", *"\t\n\x0b\x0c\r"])
    begins, ends = (F.col("at") <= 0) | blank(F.lit(1)), (F.col("at") + size >= F.col("points")) | blank(led + size + 1)
    ongoing = (F.col("at") + size < F.col("points")).alias("after")
    part = F.substring(F.col("around"), led + 1, size)
    taken = taken.select(*key, "low", "high", "from", "own", "print", begins.alias("begins"), ends.alias("ends"), ongoing, part.alias("part"))
    # Both sides of an alignment meet by one shuffle of their parts, which has nothing to sort or sum up before.
    taken = taken.repartition(*key)
    own, other = (lambda c: F.first(F.when(F.col("own"), F.col(c)), ignorenulls=True)), (lambda c: F.first(F.when(~F.col("own"), F.col(c)), ignorenulls=True))
    met = taken.groupBy(*key).agg(*(F.first(c).alias(c) for c in ("low", "high", "from")), *(own(c).alias(c) for c in ("print", "begins", "ends")), (own("after") & other("after")).alias("after"), own("part").alias("left"), other("part").alias("text"))
    before = F.col("from") > F.greatest(F.lit(0), F.col("shift"))
    both = met.select(*key, "low", "high", "print", "from", "begins", "ends", before.alias("before"), "after", F.col("left").alias("own"), "text")
    return both.mapInArrow(partial(_verify, min_words=min_words), _FOUND)


def _all_compared(texts: DataFrame, aligned: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, print, start, end, n_words, first_doc): all alignments compared until the texts differ."""
    margin, parts = MARGIN, []
    while True:
        found = cut(_compared(texts, aligned, margin, min_words))
        parts.append(found.where("n_words > 0").select("doc_id", "print", "start", "end", "n_words", "first_doc"))
        aligned = found.where("n_words = 0").select("doc_id", F.col("first_doc").alias("other"), "shift", "low", "high")
        if aligned.isEmpty():
            return reduce(DataFrame.union, parts)
        margin *= GROWTH


def _whole(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """The passages of texts that others equal: all of their words."""
    for batch in batches:
        out = []
        for doc_id, print_, other, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "print", "other", "text")), strict=True):
            first, last, words = whole_words(np.frombuffer(text.encode("utf-32-le"), "<u4"), 0, len(text), True, True)
            if words >= min_words:
                out.append((doc_id, print_, first, last, words, other))
        columns = list(zip(*out, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()], strict=True)], ["doc_id", "print", "start", "end", "n_words", "first_doc"])


def _passages(docs: DataFrame, id_col: str, text_col: str, min_words: int, later_only: bool) -> DataFrame:
    """(doc_id, print, start, end, n_words, first_doc); print is the hash of the document's text."""
    texts = one_text_each(ids_and_text(docs, id_col, text_col).where("doc_id is not null and text is not null"))
    hashed = texts.select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    equal = cut(hashed.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last"))
    known = hashed.join(sized(equal), ["h1", "h2"], "left")
    copies = known.where("first is not null" + (" and doc_id > first" if later_only else ""))
    other = F.when(F.col("doc_id") == F.col("first"), F.col("last")).otherwise(F.col("first"))
    whole = copies.select("doc_id", F.col("h1").alias("print"), other.alias("other"), "text").mapInArrow(partial(_whole, min_words=min_words), "doc_id long, print long, start int, end int, n_words int, first_doc long")
    single = known.where("first is null or first = doc_id").select("doc_id", "text")
    aligned = cut(alignments(single, later_only))
    found = _all_compared(single, aligned, min_words).union(whole)
    order = Window.partitionBy("doc_id", "print").orderBy("start", F.desc("end"), "first_doc")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("before", before).where("before is null or end > before").drop("before")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, later_only: bool = False) -> DataFrame:
    """(doc_id, start, end, n_words, first_doc): every passage that another document, first_doc, has as a whole.

    first_doc is the document of smallest id that has the seed the passage was found by, or
    for that document itself the one of greatest id.  later_only: passages that a document
    of smaller id has.
    """
    return _passages(docs, id_col, text_col, min_words, later_only).drop("print")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without passages that a document of smaller id has, too."""
    spans = _passages(docs, id_col, text_col, min_words, later_only=True)
    by_doc = spans.groupBy("doc_id", "print").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("r"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    text = F.col("text")
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    # Passages may overlap: what follows one begins where the last of those so far ends.
    piece = lambda a, to: F.substring(text, a["at"] + 1, F.greatest(F.lit(0), to - a["at"]))
    step = lambda a, s: F.struct(F.concat(a["text"], piece(a, s["start"])).alias("text"), F.greatest(a["at"], s["end"]).alias("at"))
    rest = F.aggregate("spans", start, step, lambda a: F.concat(a["text"], piece(a, F.length(text))))
    found = row.join(by_doc, (F.col("id") == F.col("doc_id")) & (F.xxhash64("text") == F.col("print")), "left")
    return found.select(F.when(F.col("spans").isNull(), F.col("r")).otherwise(F.col("r").withField(f"`{text_col}`", rest)).alias("r")).select("r.*")
