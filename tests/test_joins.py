"""Joins of records: groups and lines give what one fold of a whole table gives."""

import random

import pytest
from pyspark.sql import functions as F

from gridweave.operators import records as R
from gridweave.operators.extract import extract
from gridweave.plans.rtl import compile_pattern
from gridweave.sources.grids import grid_of_rows

ROWS = "[ [VAL : RT->REC, {0}->JOIN{1}] [VAL] [VAL] ]+"
SUBTABLES = "{{ [ ['#' ? SKIP] [VAL] [VAL] ] [ [!'#' ? VAL : RT->REC, {0}->JOIN{1}] [VAL] [VAL] ]+ }}+"
CELLS = "[ [VAL : (P0&C0)->REC, {0}->JOIN{1}]+ ]+"
EITHER = "[ ['b' ? VAL : RT->REC, {0}->JOIN{1} | VAL : 'K'->AVP, RT*->REC, {0}->JOIN{1}] [VAL] [VAL] ]+"
PARTS = "[ [(VAL : RT->REC, {0}->JOIN{1}){{','}}] [VAL] [VAL] ]+"
GROUPED = ["BW*", "(BW&STR)*", "SC*", "(SC&STR)*", "COL*", "ST*", "(STR&ST)*", "NCL*", "(NCL&STR)*", "RT*", "(SR&STR)*", "ROW*", "(STR)*"]
FOLDED = ["BW", "-AV{2}", "AV*", "(BW|AV){2}", "(COL&!'b')*", "(BW&STR)", "NCL{2}", "-NCL*", "^ST*", "R+1", "(R+2&C+0)", "(LT|RT)*", "LT*"]


@pytest.fixture(scope="module")
def grids(spark):
    rng = random.Random(11)
    cell = lambda: rng.choice(["a", "b", "c", "b,a"])
    made = []
    for _ in range(14):
        rows = [["#", cell(), cell()]] + [[rng.choice(["#", "a", "b", "c", "b,a"]), cell(), cell()] for _ in range(rng.randint(1, 7))] + [["a", cell(), cell()]]
        # No subtable is without rows.
        made.append([r for i, r in enumerate(rows) if r[0] != "#" or rows[i + 1][0] != "#"])
    return spark.createDataFrame(list(enumerate(made)), "table_id int, grid array<array<string>>").repartition(2).cache()


def found(grids, pattern, cells, **options):
    each = R.records(grids, pattern, R.Options(on_error="null", **options), keep=False, local_cells=cells)
    return sorted((r.table_id, r.rec_no, [(m.attr, m.val) for m in r.members]) for r in each.collect())


@pytest.mark.parametrize(("shape", "drop"), [(ROWS, "(0)"), (SUBTABLES, ""), (CELLS, "(1)"), (EITHER, "(0)"), (PARTS, "")], ids=["rows", "subtables", "cells", "either", "parts"])
def test_groups_and_lines_equal_the_fold(spark, grids, monkeypatch, shape, drop):
    rng = random.Random(shape + drop)
    for lookup in [*rng.sample(GROUPED, 2), *rng.sample(FOLDED, 2)]:
        pattern = compile_pattern(shape.format(lookup, drop))
        own = [found(grids, pattern, n) for n in (0, 1000)]
        with monkeypatch.context() as patch:
            patch.setattr(R, "grouping", lambda *_: None)
            patch.setattr(R, "join_lines", lambda *_: [])
            whole = found(grids, pattern, 0)
        assert whole and own == [whole, whole], lookup


def test_which_joins_are_groups_and_lines():
    options = R.Options()
    for lookup in GROUPED:
        assert R.grouping(compile_pattern(ROWS.format(lookup, "")), options), lookup
        # Several records of a cell don't find each other along a line.
        assert R.grouping(compile_pattern(PARTS.format(lookup, "")), options) is None
        assert R.grouping(compile_pattern(ROWS.format(lookup, "")), R.Options(actions_by="column")) is None
    for lookup in FOLDED:
        assert R.grouping(compile_pattern(ROWS.format(lookup, "")), options) is None, lookup
    lines = lambda lookup: R.join_lines(R.Atoms(compile_pattern(ROWS.format(lookup, ""))).atoms)
    assert lines("(BW|AV){2}") == ["col", "subtable"] and lines("(BW|RT)*") == [] and lines("(LT|RT)*") == ["row", "subrow"] and lines("(NCL&STR){2}") == ["s"]


def test_null_and_repeated_ids_are_joined_apart(spark):
    grid = [["a", "1", "2"], ["b", "3", "4"], ["a", "5", "6"]]
    tables = spark.createDataFrame([(None, grid), (None, grid), (7, grid), (7, grid)], "table_id int, grid array<array<string>>")
    for lookup, records in (("ST*", [["a", "1", "b", "3", "a", "5"]]), ("BW", [["a", "1", "b", "3"], ["a", "5"]])):
        for cells in (0, 1000):
            each = R.records(tables, compile_pattern(ROWS.format(lookup, "")), keep=False, local_cells=cells).collect()
            assert sorted((r.rec_no, [m.val for m in r.members]) for r in each) == sorted(list(enumerate(records)) * 4)


N = 100_000


def test_tall_tables(spark):
    """One table of 100,000 rows: joined as a whole, by string, and in twos."""
    rows = spark.range(N).select(F.lit(1).alias("t"), "id", (F.col("id") % 40_000).cast("string").alias("k"), F.col("id").cast("string").alias("v"))
    grids = grid_of_rows(rows, ["t"], ["id"], ["k", "v"]).cache()
    joins = lambda text: R.records(grids, compile_pattern(f"[ [VAL : RT->REC, {text}] [VAL] ]+"), keep=False)

    (whole,) = joins("ST*->JOIN(0)").collect()
    assert [m.val for m in whole.members] == ["0", *map(str, range(N))]

    by_text = joins("(ST&STR)*->JOIN(0)")
    plan = by_text._jdf.queryExecution().optimizedPlan().toString()
    assert "InArrow" not in plan
    every = sorted(by_text.select("rec_no", F.transform("members", lambda m: m["val"].cast("int"))).collect())
    assert [(r[0], list(r[1])) for r in every] == [(k, [k, *range(k, N, 40_000)]) for k in range(40_000)]

    two = extract(grids, "[ [VAL : RT->REC, BW->JOIN(0)] [VAL] ]+", ["$a_1", "$a_2", "$a_3"], keep=False)
    assert two.count() == N // 2 and two.where("rec_no = 700").collect()[0][2:] == ("1400", "1400", "1401")
