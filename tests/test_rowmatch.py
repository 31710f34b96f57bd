"""Matching by regular expressions against the matcher that states the rules."""

import random

import pytest
from pyspark.sql import functions as F

from gridweave.operators.extract import extract
from gridweave.operators.match import Shape, match
from gridweave.operators.rowmatch import Automaton
from gridweave.plans.rtl import compile_pattern
from gridweave.sources.grids import grid_of_rows

SCHEMA = "table_id int, grid array<array<string>>"


def random_pattern(rng):
    mark = lambda low=0: rng.choice(["", "", "+", "?", "*", "{2}"][low:])
    guard = lambda: rng.choice(["", "", "'a' ? ", "!BLANK ? ", "~'b' ? "])
    cell = lambda: "[" + guard() + rng.choice(["VAL", "SKIP", "ATTR", "'a' ? VAL | AUX", "(VAL){','}"]) + "]" + mark()

    def row():
        if rng.random() < 0.5:
            inside = " ".join(cell() for _ in range(rng.randint(1, 3)))
        else:
            inside = " ".join("{ " + " ".join(cell() for _ in range(rng.randint(1, 2))) + " }" + mark() for _ in range(rng.randint(1, 2)))
        return "[ " + (rng.choice(["", "", "", "!BLANK ? "])) + inside + " ]" + mark()

    if rng.random() < 0.5:
        return " ".join(row() for _ in range(rng.randint(1, 3)))
    return " ".join("{ " + " ".join(row() for _ in range(rng.randint(1, 2))) + " }" + mark() for _ in range(rng.randint(1, 2)))


def random_grids(rng, n):
    grids = []
    for _ in range(n):
        width = rng.randint(1, 4)
        grids.append([[rng.choice(["a", "a", "b", "", "ab", "x,y"]) for _ in range(width)] for _ in range(rng.randint(1, 4))])
    return [*grids, None, [], [[]], [["a"], ["a", "b"]], [["a", None]], [[""]]]


def test_same_as_the_rules(spark):
    rng = random.Random(11)
    grids = random_grids(rng, 250)
    df = spark.createDataFrame(list(enumerate(grids)), SCHEMA)
    regular = matched = tried = 0
    while regular < 25:
        tried += 1
        try:
            pattern = compile_pattern(random_pattern(rng))
        except Exception:  # noqa: BLE001, S112
            continue
        if not Automaton(Shape(pattern)).possible:
            continue
        regular += 1
        both = match(match(df, pattern).withColumnRenamed("cells", "own"), pattern, in_python=True)
        got = both.select("table_id", "own", "cells").collect()
        for r in got:
            assert r.own == r.cells, (pattern, grids[r.table_id])
        matched += sum(r.own is not None for r in got)
    assert matched > 200 and tried < 2000


REGULAR = {
    "[ [VAL : 'KEY'->AVP, RT*->REC] [VAL : 'STATUS'->AVP] [VAL : 'PRIORITY'->AVP] ]": True,
    "[ ['(' VAL : CL*->REC ',' VAL ')'] ]": True,
    "{ [ [VAL] [VAL] ] [ [AUX] [VAL] ]+ }+": True,
    "[ { [VAL] [VAL] }+ ]": True,
    "[ { [VAL] [VAL] }+ [VAL] ]": False,  # repetitions that may be given back
    "[ { 'a' ? [VAL] }+ ]": False,
    "{ BLANK ? [ [VAL]+ ] }+": False,
    "[ [VAL]* ]": False,
}


@pytest.mark.parametrize("pattern", REGULAR)
def test_which_are_regular(pattern):
    assert Automaton(Shape(compile_pattern(pattern))).possible == REGULAR[pattern]


def test_no_python_in_plans(spark):
    df = spark.createDataFrame([(1, [["a", "b"]])], SCHEMA)
    for pattern in ("[ [VAL : 'K'->AVP, RT*->REC] [VAL : 'V'->AVP] ]+", "[ [VAL : 'K'->AVP, RT->REC, (BW&STR)*->JOIN(0)] [BLANK ? SKIP | VAL : 'V'->AVP] ]+"):
        for cells in (0, 64):
            plan = extract(df, pattern, ["K", "V"], keep=False, local_cells=cells)._jdf.queryExecution().toString()
            assert "Python" not in plan and "Arrow" not in plan


def test_many_rows_and_repetitions(spark):
    """100,000 rows in sections of two, 5,000 cells in pairs: no deep recursion."""
    rows = spark.range(100_000).select(F.lit(1).alias("t"), "id", F.when(F.col("id") % 2 == 0, "h").otherwise("v").alias("k"))
    tall = grid_of_rows(rows, ["t"], ["id"], ["k"])
    got = match(tall, compile_pattern("{ [ ['h' ? VAL] ] [ [VAL] ] }+")).select(F.size("cells").alias("n"), F.col("cells")[99_999]["subtable"].alias("last")).first()
    assert tuple(got) == (100_000, 49_999)
    wide = spark.createDataFrame([(1, [["x"] * 5000])], SCHEMA)
    got = match(wide, compile_pattern("[ { [VAL] [VAL] }+ ]")).select(F.col("cells")[4999]["subrow"].alias("last")).first()
    assert got.last == 2499
