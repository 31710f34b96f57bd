"""What records of small tables read off their arrays: no copies of items, each name's place found once."""

from pyspark.sql import functions as F

from gridweave.operators import local
from gridweave.operators.extract import extract, wide_members
from gridweave.operators.items import item_arrays
from gridweave.operators.records import MEMBERS, Options
from gridweave.plans.rtl import compile_pattern

BY_KEY = "[ [VAL : RT->REC, (BW&STR)*->JOIN(0)] [VAL] ]+"
GRID = "table_id int, grid array<array<string>>"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_grouped_joins_keep_no_items(spark):
    grids = spark.createDataFrame([(1, [["a", "1"], ["b", "2"], ["a", "3"]]), (2, [[None, "4"], ["", "5"]] * 20), (None, [["b", None]] * 40)], GRID)
    made = extract(grids, BY_KEY, ["$a_1", "$a_2", "$a_3"])
    assert "InMemoryRelation" not in plan(made)
    assert "InMemoryRelation" in plan(extract(grids, "[ [VAL : RT->REC, (BW|AV)*->JOIN(0)] [VAL] ]+", ["$a_1", "$a_2", "$a_3"]))
    rows = sorted(map(tuple, made.collect()), key=str)
    for cells in (0, 1000):
        assert sorted(map(tuple, extract(grids, BY_KEY, ["$a_1", "$a_2", "$a_3"], local_cells=cells).collect()), key=str) == rows
    assert rows == sorted([(1, 0, "a", "1", "3"), (1, 1, "b", "2", None), (2, 0, "", "4", "5"), (None, 0, "b", "", "")], key=str)


def test_the_last_member_of_a_name_counts(spark):
    rows = [(1, 0, [(1, "a", "x"), (2, None, "y"), (3, "a", "z"), (4, "b", None)]), (1, 1, []), (2, 0, None), (2, 1, [(1, "b", "x"), (2, "b", None)]), (2, 2, [(1, "b", None), (2, "b", "y")])]
    wide = wide_members(spark.createDataFrame(rows, f"table_id int, rec_no int, members {MEMBERS}"), ["a", "b", "c"])
    assert [tuple(r) for r in wide.orderBy("table_id", "rec_no").collect()] == [(1, 0, "z", None, None), (1, 1, None, None, None), (2, 0, None, None, None), (2, 1, None, None, None), (2, 2, None, "y", None)]
    assert "exists(" not in plan(wide)


def test_items_are_written_down_once(spark):
    grids = spark.createDataFrame([(1, [["a", None], ["b", "2"]])], GRID)
    pattern = compile_pattern(BY_KEY)
    items = item_arrays(grids, pattern)
    assert [(i["seq"] >> 20, i["atom"], i["idx"], i["s"], i["kind"], i["tags"], i["row"], i["col"], i["subtable"], i["subrow"]) for i in items.first()["items"]] == [
        (0, 0, 0, "a", "VAL", [], 0, 0, 0, 0), (1, 1, 0, "", "VAL", [], 0, 1, 0, 0), (2, 0, 0, "b", "VAL", [], 1, 0, 0, 0), (3, 1, 0, "2", "VAL", [], 1, 1, 0, 0),
    ]
    # Rows of one layout have their cells without a search, and items come straight from these.
    assert "regexp_extract" not in plan(items)
    assert "named_struct(" not in plan(local.arrays_of_records(items, compile_pattern("[ [VAL : 'K'->AVP, RT->REC] [VAL : 'V'->AVP] ]+"), Options()))
    assert [r["rec_no"] for r in local.records(grids.select(F.col("table_id"), "grid"), pattern, Options(), "table_id", "grid").collect()] == [0, 1]
