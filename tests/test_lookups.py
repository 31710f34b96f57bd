"""Lookups of large tables: the same as in small ones, and without pairs of items."""

import random

import pytest
from pyspark.sql import functions as F

from gridweave.operators.extract import extract
from gridweave.operators.lookups import one_on_a_line, scope_of
from gridweave.operators.records import record_fields
from gridweave.plans.rtl import compile_pattern
from gridweave.sources.grids import grid_of_rows

LOOKUPS = [
    *(f"{order}{line}{most}" for line in ("AV", "BW", "LT", "RT", "SR", "SC", "ROW", "COL", "ST", "NCL", "CL") for order, most in (("", "{2}"), ("-", "{3}"), ("^", "*"), ("-^", "{2}"), ("-", "*"))),
    "(ROW&!'b'){2}", "-(COL&!BLANK){2}", "(ST&STR){2}", "(NCL&STR)*", "-(BW&STR){2}", "R0*", "(C1&!'a'){2}", "-(C0..9&'a'){3}", "P1*", "(CL&P1)", "(R0&C0)", "NCL{100}", "(ROW&#'x')*",
]
PATTERN = "{{ [ [VAL#'x'] [(VAL : ({0})->REC){{','}}]+ ] [ [VAL : ({0})->REC] [(VAL){{','}}]+ ]+ }}+"


@pytest.fixture(scope="module")
def grids(spark):
    rng = random.Random(5)
    cell = lambda: rng.choice(["a", "b", "a,b", "b,c,a", "", "c"])
    made = [[["a"] + [cell() for _ in range(rng.randint(1, 3))]] for _ in range(6)]
    made = [[[g[0][0], *(cell() for _ in g[0][1:])] for _ in range(rng.randint(2, 6))] for g in made]
    return spark.createDataFrame(list(enumerate(made)), "table_id int, grid array<array<string>>").repartition(2).cache()


@pytest.mark.parametrize("part", range(6))
def test_arrays_and_rows_agree(spark, grids, part):
    """Four lookups at a time, each a provider of its own."""
    for first in range(part * 4, len(LOOKUPS), 24):
        some = LOOKUPS[first : first + 4]
        pattern = compile_pattern(PATTERN.format(", ".join(some)))
        own, other = (sorted(map(tuple, record_fields(grids, pattern, keep=False, local_cells=n).collect())) for n in (0, 1000))
        assert own == other and own, some


def _of(text):
    return compile_pattern(f"[ [VAL : {text}->REC] ]").subtables[0].rows[0].subrows[0].cells[0].content.actions[0].providers[0]


def test_which_look_along_a_line():
    assert one_on_a_line(_of("-AV&!BLANK")) and scope_of(_of("-AV{2}")) and scope_of(_of("(NCL&STR&R0)*"))
    assert scope_of(_of("(ROW|COL)*")) is None and scope_of(_of("C+1..2*")) is None and scope_of(_of("(ROW&COL)*")) is None


N = 100_000
TALL = {
    # three fields: the row's own text, and what the lookup gives
    "[ [VAL : RT->REC] [VAL : -AV{2}->PREFIX('<')] ]+": lambda i: (str(i), "<".join([str(j) for j in (i - 1, i - 2) if j >= 0] + [str(i)])),
    "[ [VAL : RT->REC] [VAL : COL{2}->SUFFIX('/')] ]+": lambda i: (str(i), "/".join([str(i), *[str(j) for j in (0, 1, 2) if j != i][:2]])),
    "[ [VAL : RT->REC] [VAL : -^NCL{2}->FILL] ]+": lambda i: (str(i), "".join(str(j) for j in ([N - 2, N - 3] if i == N - 1 else [N - 1, N - 3] if i == N - 2 else [N - 1, N - 2]))),
}


def tall(spark, n=N):
    rows = spark.range(n).select(F.lit(1).alias("t"), "id", F.col("id").cast("string").alias("k"), F.col("id").cast("string").alias("v"))
    return grid_of_rows(rows, ["t"], ["id"], ["k", "v"])


@pytest.mark.parametrize("pattern", TALL)
def test_few_of_a_tall_table(spark, pattern):
    """One table of 100,000 rows: lists of two are carried along the column; no join at all."""
    found = extract(tall(spark), pattern, ["$a_1", "$a_2"], keep=False, local_cells=0)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r.rec_no: tuple(r[2:]) for r in found.where(f"rec_no % 9999 = 0 or rec_no in (1, 2, {N - 1}, {N - 2})").collect()}
    assert len(got) > 10 and got == {i: TALL[pattern](i) for i in got}


def test_all_below_in_a_tall_table(spark):
    """One anchor takes all rows below: as much work as it has results."""
    pattern = "[ [VAL : RT->REC] [VAL : BW*->SUFFIX('/')] ] [ [] [VAL] ]+"
    row = extract(tall(spark), pattern, ["$a_1", "$a_2"], keep=False, local_cells=0).first()
    assert row[3] == "/".join(map(str, range(N)))
