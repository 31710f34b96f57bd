"""Tables of one layout: expressions on their cells give what arrays and rows of items give."""

import pytest

from gridweave.operators import fixed
from gridweave.operators.extract import extract
from gridweave.operators.records import Options, records
from gridweave.plans import catalogue
from gridweave.plans.rtl import compile_pattern

GRIDS = [
    (1, [["a", "b", "c"], ["d", "e", "f"]]), (1, [["a", None, "c"], ["d", "", " x  y "]]), (None, [["A", "b", "b"], ["b", "b", "b"]]), (2, [["1", "2", "3"]]), (3, [["1", "2", "3"]] * 3),
    (4, None), (5, []), (6, [None, ["a", "b", "c"]]), (7, [["a", "b", "c"], ["d", "e"]]), (8, [["a", "b"], ["d", "e"]]), (9, [["", "b", ""], ["d", "e", "f"]]), (10, [["a", "b", "c", "d"], ["d", "e", "f", "g"]]),
]
#: With a layout; those of which the pattern names every member come first.
NAMED = [
    "[ [VAL : 'A'->AVP, (ROW&C+1, ROW&C2, R1*)->REC] [VAL : 'B'->AVP] [VAL : 'C'->AVP] ] [ [VAL : 'D'->AVP] [VAL : 'E'->AVP] [VAL#'t' : (R0&C0..1)*->FILL('+'), 'N'->AVP] ]",
    "[ [VAL : 'A'->AVP, (RT*, @'SOURCE'='s')->REC] [VAL : 'B'->AVP, -ST{2}->PREFIX('<')] [VAL : 'C'->AVP, (COL, 'k', AV)->SUFFIX('/')] ]{2}",
    "[ { [VAL : 'A'->AVP, (SR*, ^NCL&C0&R-1)->REC] [!BLANK ? VAL : 'B'->AVP] } { [SKIP] } ] [ [VAL = UC : 'C'->AVP] []{2} ]",
    "<NORM> { [ [VAL = REPL('b', 'z').UC : 'A'->AVP, -^(ST&C1..2){2}->REC] [VAL#'q' : 'B'->AVP] [AUX] ] [ [VAL : 'A'->AVP, (C+1|C-1)->REC] [VAL : 'D'->AVP, (ROW&#'u'|COL)*->FILL(',')] [VAL#'u' : 'E'->AVP] ] }",
    "[ [VAL : 'A'->AVP, CL->REC] [VAL : 'B'->AVP, 'x'->AVP]{2} ]{2}",
]
OTHERS = [
    "{ [ [VAL : 'A'->AVP, (COL, R-1&C+1..9)->REC] [VAL : 'B'->AVP]{2} ] }{2}",
    "[ [VAL : RT*->REC] [VAL] [VAL] ]{2}",
    "[ [ATTR] [ATTR] [ATTR = UC : 'n'->PREFIX('')] ] [ [VAL : COL->AVP, RT*->REC] [VAL : AV->AVP] [VAL : (COL&#'no')->AVP, AV->AVP] ]",
    "[ [ATTR : RT{2}->FILL] [ATTR] [ATTR] ] [ [VAL : COL->AVP, RT*->REC] [VAL : 'B'->AVP] [VAL : LT->AVP, 'C'->AVP] ]",
    "[ [VAL : (RT*, 'k', @'A'='s')->REC] [VAL : 'A'->AVP] [VAL] ]{2}",
    "[ [VAL : (ST*, 'k')->REC] [VAL : ROW*->REC] [VAL : 'A'->AVP] ] [ [VAL : 'A'->AVP, 'B'->AVP] [AUX] [VAL : ROW->REC, RT->REC] ]",
    "[ [VAL : 'A'->AVP, ROW->REC] [VAL : 'B'->AVP, ROW->REC] [VAL] ]{2}",
]
NONE = ["[ [VAL : RT*->REC] [VAL]+ ]+", "[ ['a' ? VAL : RT->REC | VAL] [VAL]{2} ]{2}", "[ [(VAL){','}] [VAL : RT->REC] [VAL] ]{2}", "[ [VAL : (RT&STR)->REC] [VAL]{2} ]{2}", "[ [VAL : (RT&'b')->REC] [VAL]{2} ]{2}", "[ [VAL : RT->REC, BW->JOIN] [VAL]{2} ]{2}"]
NAMES = ["A", "B", "C", "D", "E", "N", "SOURCE", *(f"$a_{i}" for i in range(1, 9))]


@pytest.fixture(scope="module")
def grids(spark):
    return spark.createDataFrame(GRIDS, "table_id int, grid array<array<string>>")


@pytest.mark.parametrize("pattern", NAMED + OTHERS)
def test_layouts_give_what_arrays_and_rows_do(grids, pattern, monkeypatch):
    by = ("row", "column")[(NAMED + OTHERS).index(pattern) % 2]
    layout = fixed.Layout.of(compile_pattern(pattern))
    assert layout
    own = Options(actions_by=by, schema_by="position" if by == "column" else "record", on_error="null")
    assert (fixed.wide(grids, layout, own, NAMES) is not None) == (pattern in NAMED)

    wide = lambda n: sorted(map(repr, extract(grids, pattern, NAMES, options=own, local_cells=n).collect()))
    long = lambda: sorted(map(repr, records(grids, compile_pattern(pattern), own).collect()))
    given = wide(64), long()
    monkeypatch.setattr(fixed, "layout_of", lambda *_: None)
    assert given == (wide(64), long()) and given[0] == wide(0) and given[0]


@pytest.mark.parametrize("pattern", NONE)
def test_what_has_no_layout(pattern):
    assert fixed.Layout.of(compile_pattern(pattern)) is None


def test_contradicting_records_are_an_error(grids):
    with pytest.raises(Exception, match="an attribute occurs twice in a record: A, A"):
        extract(grids, "[ [VAL : 'A'->AVP, RT->REC] [VAL : 'A'->AVP] [VAL] ]{2}", ["A"]).collect()


def test_column_offsets_is_read_off_the_cells(spark):
    """The only arrays gone through are those of the rows that make the grids (before: one for each lookup and field)."""
    plan = catalogue.column_offsets(spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert plan.count("lambdafunction(") == 1
