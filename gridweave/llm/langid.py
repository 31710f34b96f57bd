"""Language identification with bit-sliced n-gram filters (operator 4).

Every language's frequent letter trigrams (with word borders) go into one Bloom filter
whose slots hold a bit per language: the conjunction of an n-gram's slots is the mask of
all languages that contain it.  A text's n-grams are counted per language bit; the counts
are corrected for the filter's false positives, whose rate per language follows from the
share of slots with its bit, and the largest corrected count decides.

Fitting takes at most about SAMPLE_DOCS labelled documents a language, chosen by a hash of
the id; an n-gram belongs to a language when it occurs in MIN_SHARE of its documents and
that is at least MIN_RATIO of the n-gram's best share, which keeps quoted passages in other
languages out.  At most MAX_GRAMS n-grams a language are kept.  Prediction reads whole texts.

Defined cases: null texts and texts without a letter are UNKNOWN with score 0, as is any
text when no language could be learned.  Ties go to the language that sorts first.
Rows without an id share one hash, so those of a language are in the sample all or none; a
repeated row is as many rows, in the sample and in the result; an empty table gives an empty
result.  Very long texts are read whole, a piece at a time.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.common import strings

UNKNOWN = "und"
SAMPLE_DOCS = 2000
MIN_SHARE = 0.02
MIN_RATIO = 0.25
MAX_GRAMS = 1 << 16
SLOTS_A_GRAM = 8
#: Multipliers of the filter's hash functions.
HASHES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_PIECE = 1 << 19


@lru_cache(1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000)


def grams(text: str) -> Iterator[np.ndarray]:
    """The trigrams centred on each letter of a lower-cased text, piece by piece; other characters are borders."""
    low = text.lower()
    for at in range(0, len(low), _PIECE):
        part = low[max(0, at - 1) : at + _PIECE + 1]
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")
        letter = _letters()[points]
        z = np.zeros(len(points) + 2, np.uint64)
        z[1:-1] = np.where(letter, points, 0)
        first = 1 if at else 0
        centre = np.flatnonzero(letter[first : first + min(_PIECE, len(low) - at)]) + first + 1
        yield (z[centre - 1] << np.uint64(42)) | (z[centre] << np.uint64(21)) | z[centre + 1]


class Filter:
    """The bit-sliced filter of the learned languages."""

    def __init__(self, by_language: dict[str, np.ndarray]):
        self.languages = sorted(by_language)
        most = max((len(g) for g in by_language.values()), default=0)
        self.bits = max(10, int(most * SLOTS_A_GRAM - 1).bit_length()) if most else 10
        self.words = max(1, -(-len(self.languages) // 64))
        self.table = np.zeros((self.words, 1 << self.bits), np.uint64)
        for i, name in enumerate(self.languages):
            for slots in self._slots(by_language[name]):
                self.table[i // 64, slots] |= np.uint64(1 << i % 64)
        fill = np.array([((self.table[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(self.languages))])
        self.false_positive = fill ** len(HASHES)

    def _slots(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        mixed = keys ^ (keys >> np.uint64(29))
        for m in HASHES:
            yield (mixed * np.uint64(m)) >> np.uint64(64 - self.bits)

    def masks(self, keys: np.ndarray) -> np.ndarray:
        """(words, n): for each n-gram the bits of all languages that contain it."""
        out = np.full((self.words, len(keys)), np.uint64(0xFFFFFFFFFFFFFFFF))
        for slots in self._slots(keys):
            out &= self.table[:, slots]
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and the share of n-grams that it explains."""
        n, counts = 0, np.zeros(len(self.languages))
        for keys in grams(text or ""):
            n += len(keys)
            masks = self.masks(keys)
            for i in range(len(self.languages)):
                counts[i] += int(((masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).sum())
        if not n or not self.languages:
            return UNKNOWN, 0.0
        true = np.maximum(0, (counts - n * self.false_positive) / (1 - self.false_positive))
        best = int(true.argmax())
        return self.languages[best], float(min(1.0, true[best] / n))


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each language, in how many of the documents an n-gram occurs."""
    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        for lang in sorted(set(langs)):
            own = [np.unique(np.concatenate([np.unique(g) for g in grams(t)])) for t, x in zip(texts, langs, strict=True) if x == lang and t]
            if own:
                keys, n = np.unique(np.concatenate(own), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Filter:
    """Fit the filter from the rows given; rows without a language or text are left out."""
    rows = labelled.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where("lang is not null and text is not null")
    there = {r["lang"]: r["count"] for r in rows.select("lang").groupBy("lang").count().collect()}
    if not there:
        return Filter({})
    share = F.create_map(*(x for k, n in there.items() for x in (F.lit(k), F.lit(sample_docs / n))))
    chance = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where(chance < share[F.col("lang")]).select("lang", "text")
    counted = sample.mapInArrow(_gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    size = F.create_map(*(x for k, n in there.items() for x in (F.lit(k), F.lit(float(min(n, sample_docs))))))
    shares = counted.withColumn("share", F.col("n") / size[F.col("lang")])
    best = shares.withColumn("best", F.max("share").over(Window.partitionBy("gram")))
    # In a language of few documents a single occurrence counts.
    enough = (F.col("share") >= MIN_SHARE) & ((F.col("n") > 1) | (size[F.col("lang")] < 1 / MIN_SHARE))
    kept = best.where(enough & (F.col("share") >= MIN_RATIO * F.col("best")))
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("share"), "gram")))
    found = ranked.where(F.col("rank") <= MAX_GRAMS).select("lang", "gram").toArrow()
    langs, keys = np.array(found["lang"].to_pylist(), object), found["gram"].to_numpy().view(np.uint64)
    return Filter({k: keys[langs == k] for k in there if (langs == k).any()})


def predict(model: Filter, text: Column | str, spark) -> Column:
    """Struct of language and score for a text column."""
    shared = spark.sparkContext.broadcast(model)

    def predicted(texts: pa.Array) -> pa.Array:
        out = [shared.value.predict(x) for x in strings(texts)]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())], ["lang", "score"])

    return F.arrow_udf(predicted, "struct<lang:string,score:double>")(text)
