"""Every input row is a table, whatever its id; small and large tables give the same."""

import pytest

from gridweave.operators.extract import extract
from gridweave.operators.records import Options, record_fields
from gridweave.plans.rtl import compile_pattern

SCHEMA = "table_id int, grid array<array<string>>"
NAMED = "[ [VAL : 'K'->AVP, RT->REC] [VAL : 'V'->AVP] ]+"
PATTERNS = [
    NAMED,
    "[ [VAL : RT->REC] [VAL] ]+",
    "[ [VAL : RT->REC, (BW&STR)*->JOIN(0)] [VAL] ]+",
    "[ [VAL : RT->REC, BW->JOIN] [VAL] ]+",
    "[ [ATTR]+ ] [ [VAL : COL->AVP, RT*->REC] [VAL : COL->AVP] ]+",
    "[ [VAL : RT->REC] [VAL : -AV{2}->PREFIX('<')] ]+",
]
A, B, C = [["a", "1"], ["b", "2"]], [["c", "3"]], [["a", "4"], ["a", "5"], ["d", "6"]]
TABLES = [(1, A), (1, A), (1, B), (None, A), (None, C), (2, C), (3, [["x"]]), (4, None), (None, None), (5, [])]


@pytest.mark.parametrize("pattern", PATTERNS)
@pytest.mark.parametrize("cells", [0, 64])
def test_null_and_repeated_ids(spark, pattern, cells):
    """All rows together give what each gives alone."""
    schema = {NAMED: ["K", "V"]}.get(pattern) or (["a", "c", "1", "3", "4"] if "ATTR" in pattern else [f"$a_{i}" for i in range(1, 7)])
    found = extract(spark.createDataFrame(TABLES, SCHEMA).repartition(3), pattern, schema, keep=False, local_cells=cells)
    each = []
    for grid in {str(g): g for _, g in TABLES}.values():
        alone = extract(spark.createDataFrame([(0, grid)], SCHEMA), pattern, schema, keep=False, local_cells=64).collect()
        each += [(i, *r[1:]) for r in alone for i, g in TABLES if g == grid]
    text = lambda rows: sorted(map(str, map(tuple, rows)))
    assert text(found.collect()) == text(each)


@pytest.mark.parametrize("cells", [0, 64])
def test_records_in_order_of_tables(spark, cells):
    """Repeated ids have record numbers from 0 on each, and attributes are found over all of them."""
    df = spark.createDataFrame(TABLES, SCHEMA)
    found = extract(df, NAMED, keep=False, local_cells=cells)
    assert found.columns == ["table_id", "rec_no", "K", "V"]
    assert sorted(r.rec_no for r in found.where("table_id = 1").collect()) == [0, 0, 0, 1, 1]
    assert found.where("table_id is null").count() == 5
    fields = record_fields(df, compile_pattern(NAMED), Options(), keep=False, local_cells=cells)
    assert fields.where("table_id is null").count() == 10


def test_ids_of_any_type(spark):
    df = spark.createDataFrame([(("x", 1), B), (("x", 1), B), (None, B)], "key struct<a:string,b:int>, grid array<array<string>>")
    for cells in (0, 64):
        got = extract(df, NAMED, ["K", "V"], table_id="key", keep=False, local_cells=cells)
        assert sorted(str(r.table_id) for r in got.collect()) == sorted([str(df.first().key)] * 2 + ["None"])
