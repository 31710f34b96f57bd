"""Records within rows are numbered by their rows, if each row makes as many."""

import pytest
from pyspark.sql import functions as F

from gridweave.operators import chunked
from gridweave.operators.chunked import extract_rows
from gridweave.operators.match import Shape
from gridweave.plans.rtl import compile_pattern

TWO = "[ [VAL : 'K'->AVP, LT->REC] [VAL : 'K'->AVP, RT->REC] ]+"
EITHER = "[ ['a' ? VAL : 'K'->AVP, RT->REC] [VAL : 'V'->AVP] ] [ [!'a' ? VAL : 'K'->AVP, RT->REC] [VAL : 'V'->AVP] ]*"
HEADED = "[ [SKIP] [SKIP] ] [ [VAL : 'K'->AVP, RT->REC] [VAL : 'V'->AVP] ]+"


def rows_of(spark):
    own = [(t, i * 7_000, ["a" if i == 0 else str(i), None if i == 3 else f"v{i}"]) for t, n in ((1, 2500), (None, 5), (2, 1)) for i in range(n)]
    return spark.createDataFrame([*own, (3, 0, ["a", "b"]), (3, 1, ["a"])], "table_id int, row long, cells array<string>").repartition(3)


@pytest.mark.parametrize("pattern", [TWO, EITHER, HEADED], ids=["two", "either", "headed"])
def test_numbers_as_counted(spark, monkeypatch, pattern):
    made = lambda: sorted(map(tuple, extract_rows(rows_of(spark), pattern, ["K", "V"]).collect()), key=str)
    own = made()
    monkeypatch.setattr(chunked, "records_of_a_row", lambda *_: None)
    assert own == made() and len(own) > 2500
    spark.catalog.clearCache()


def test_which_rows_make_as_many():
    per_row = lambda text: chunked.records_of_a_row(chunked.layouts_of(Shape(compile_pattern(text))), compile_pattern(text))
    assert [per_row(p) for p in (TWO, EITHER, HEADED)] == [2, 1, None]
    assert per_row("[ [VAL : 'K'->AVP] [(VAL : 'V'->AVP, (ROW&C0)->REC){','}] ]+") is None


def test_no_records_are_counted_or_sorted(spark):
    found = extract_rows(rows_of(spark), EITHER, ["K", "V"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "members" not in plan.partition("InMemoryRelation")[2]
    assert found.where(F.col("table_id") == 1).agg(F.max("rec_no")).first()[0] == 2499
    spark.catalog.clearCache()
