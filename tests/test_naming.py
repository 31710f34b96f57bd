"""Naming and joins of small tables as arrays: what rows give, and nothing dealt anew for it."""

import pytest
from pyspark.sql import functions as F

from gridweave.operators.extract import extract
from gridweave.operators.items import most_cells
from gridweave.operators.records import Options
from gridweave.plans import catalogue
from gridweave.plans.rtl import compile_pattern

GRIDS = [
    (1, [["a", "b", "c"], ["d", "e", "f"], ["a", "", "g"]]), (2, [["x", "y", "z"]]), (2, [["p", "p", "p"], ["p", "q", "p"]]), (None, [["1", "2", "3"]] * 4), (5, None), (6, [["a", "b", "c"], ["a"]]), (7, [["n", "F", "o"], ["m", "G", "o"]]),
]
PATTERNS = [
    "[ [VAL : RT*->REC] [VAL] [VAL] ]+",
    "[ [VAL : (LT, RT*, 'k', @'SOURCE'='s')->REC(1)] [VAL] [VAL] ]+",
    "[ [VAL : ST*->REC] [VAL : ST*->REC] [VAL] ]+",
    "[ [VAL : 'A'->AVP, RT*->REC] [VAL : RT*->REC] [VAL] ]+",
    "[ [VAL : RT*->REC] ['F' ? VAL : 'N'->AVP, RT->REC | VAL] [VAL] ]+",
    "[ [VAL : RT->REC, BW->JOIN(0)] [VAL] [VAL] ]+",
    "[ [VAL : 'A'->AVP, RT*->REC, -AV->JOIN, BW*->JOIN(0)] [VAL : 'B'->AVP] [VAL] ]+",
    "[ [VAL : 'A'->AVP, RT*->REC] [VAL : 'A'->AVP] [VAL] ]+",
    "[ ['[a-m]' ? VAL : 'A'->AVP, RT*->REC | VAL : 'B'->AVP, RT*->REC] [VAL] [VAL] ]+",
    "[ [VAL : 'A'->AVP, RT->REC] ['[a-g]' ? VAL : 'A'->AVP | VAL] ['[a-m]' ? VAL : 'C'->AVP, LT*->REC | VAL : 'D'->AVP, LT*->REC] ]+",
]
NAMES = ["A", "B", "C", "D", "N", "SOURCE", *(f"$a_{i}" for i in range(1, 9))]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_arrays_name_as_rows_do(spark, pattern):
    grids = spark.createDataFrame(GRIDS, "table_id int, grid array<array<string>>")
    own = Options(schema_by=("record", "position")[PATTERNS.index(pattern) % 2], on_error="null")
    found = [sorted(map(repr, extract(grids, pattern, NAMES, options=own, local_cells=n).collect())) for n in (None, 0)]
    assert found[0] == found[1] and found[0]


def test_different_anchors_are_an_error_in_arrays(spark):
    grids = spark.createDataFrame([(1, [["a"], ["z"]])], "table_id int, grid array<array<string>>")
    with pytest.raises(Exception, match="anchors have different attributes: A, B"):
        extract(grids, "[ ['a' ? VAL : 'A'->AVP, (COL&'q')->REC | VAL : 'B'->AVP, (COL&'q')->REC] ]+", ["A", "B"]).collect()


@pytest.mark.parametrize("name", ["constants", "fragments", "relative_ranges"])
def test_names_of_small_tables_need_no_shuffle(spark, name):
    """One shuffle, that of the grids, and no window beside it."""
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 0
    assert plan.count("RepartitionByExpression") == 1


def test_cells_that_a_pattern_has_at_most():
    assert most_cells(compile_pattern("[ [VAL] [VAL]{3} ]{2}")) == 8
    assert most_cells(compile_pattern("[ [VAL] [VAL]+ ]{2}")) is None
    assert most_cells(compile_pattern("[ [VAL] ]*")) is None


def test_tables_larger_than_the_pattern_do_not_match(spark):
    rows = spark.range(1).select(F.lit(1).alias("table_id"), F.array_repeat(F.array(F.lit("a")), 70).alias("grid"))
    assert extract(rows, "[ [VAL : RT*->REC] ]", ["$a_1"]).count() == 0
    assert extract(rows, "[ [VAL : RT*->REC] ]+", ["$a_1"]).count() == 70
