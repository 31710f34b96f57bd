"""Words of a language that few toxic documents are in."""

import numpy as np
from pyspark.sql import functions as F

from gridweave.llm import toxicity


def test_rare_language_is_learned(spark):
    """6 of 406 toxic documents (1.5 %) are in another language, with a toxic word of its own."""
    rng = np.random.default_rng(9)
    common, other = [f"word{a}{b}" for a in "abcdefgh" for b in "abcdefgh"], [f"voz{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]

    def text(vocabulary, bad=None):
        return " ".join([*(vocabulary[i] for i in rng.integers(0, 64, 20)), *([bad] if bad else [])])

    rows = [(i, text(common, "stinker"), 1) for i in range(400)] + [(400 + i, text(other, "apestoso"), 1) for i in range(6)]
    rows += [(1000 + i, text(common), 0) for i in range(1600)]
    rows += [(3000 + i, text(common, "stinker" if i % 5 == 0 else None), None) for i in range(800)] + [(4000 + i, text(other, "apestoso" if i < 3 else None), None) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.where(F.col("toxic").isNotNull()).select("doc_id", "toxic"))
    assert model.score(text(other, "apestoso")) >= 0.3 > model.score(text(other))
    assert model.score(text(common, "stinker")) >= 0.3 > model.score(text(common))
