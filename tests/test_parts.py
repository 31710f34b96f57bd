"""Cells of many delimited parts: work in proportion to the parts."""

import time

from gridweave.operators.extract import extract
from gridweave.operators.items import most_items
from gridweave.plans.rtl import compile_pattern

PATTERN = "[ [VAL : 'N'->AVP] [(VAL : 'WORD'->AVP, (ROW&C0)->REC){' '}] ]"
SCHEMA = "table_id int, grid array<array<string>>"


def took(spark, n):
    df = spark.createDataFrame([(1, [["7", " ".join(f"w{i}" for i in range(n))]]), (2, [["8", "a b"]])], SCHEMA)
    t = time.time()
    rows = extract(df, PATTERN, ["WORD", "N"], keep=False).collect()
    assert len(rows) == n + 2 and {r.WORD for r in rows if r.table_id == 1} == {f"w{i}" for i in range(n)} and {r.N for r in rows} == {"7", "8"}
    return time.time() - t


def test_linear_in_parts(spark):
    took(spark, 200)  # plans are compiled
    small, large = took(spark, 2_000), took(spark, 20_000)
    assert large < 10 * small + 3, (small, large)


def test_most_items(spark):
    df = spark.createDataFrame([(1, [["a b c", None], ["", "x"]]), (2, None)], SCHEMA)
    count = most_items(compile_pattern("[ [(VAL){' '}]+ ]+"), df["grid"], lambda c: c)
    assert [r[0] for r in df.select(count).collect()] == [6, None]
    assert most_items(compile_pattern("[ [VAL] ]"), df["grid"], lambda c: c) is None
