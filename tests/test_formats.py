"""Cells with formatting, merged regions, and splits of declared width."""

import pytest
from pyspark.sql import functions as F

from gridweave.operators.extract import extract, inspected
from gridweave.plans import spec as S
from gridweave.plans.rtl import Bindings
from gridweave.sources.grids import fill_merged
from gridweave.streaming.tables import extract_stream, parquet_sink

CELL = "struct<text:string,font:struct<family:string,bold:boolean>,border:array<int>>"


def formatted(spark, *grids):
    return spark.createDataFrame([(i, [[(t, ("serif", b), n) for t, b, n in row] for row in g]) for i, g in enumerate(grids)], f"table_id int, grid array<array<{CELL}>>")


@pytest.mark.parametrize("cells", [0, 64])
def test_fonts_and_borders(spark, cells):
    df = formatted(spark, [[("a", True, [1]), ("b", False, None)], [("c", False, [0]), ("d", None, [])], [(None, True, [1]), ("e:f", True, [2])]])
    own = Bindings().cell("bold", lambda c: c["font"]["bold"], whole=True).cell("line", lambda c: F.array_contains(c["border"], 1), whole=True).cell("short", lambda t: len(t) < 2)
    pattern = "[ [EXT('bold') ? VAL : 'K'->AVP, RT->REC | VAL : 'K'->AVP] [VAL : 'V'->AVP] ]+"
    got = extract(df, pattern, ["K", "V"], bindings=own, keep=False, local_cells=cells)
    assert [tuple(r)[2:] for r in got.orderBy("rec_no").collect()] == [("a", "b"), ("", "e:f")]
    # With a test in Python beside it, matching is done there; a test of null is false.
    mixed = "[ [EXT('line') ? VAL : 'K'->AVP, RT->REC | SKIP] [EXT('short') ? VAL = UC : 'V'->AVP | VAL : 'V'->AVP] ]+"
    got = extract(df, mixed, ["K", "V"], bindings=own, keep=False, local_cells=cells)
    assert [tuple(r)[2:] for r in got.orderBy("rec_no").collect()] == [("a", "B"), ("", "e:f")]
    compound = "[ [] [] ]{2} [ [] [VAL : CL->REC ':' VAL] ]"
    assert tuple(extract(df, compound, ["$a_1", "$a_2"], keep=False, local_cells=cells).first())[2:] == ("e", "f")


def test_whole_cells_need_structs(spark):
    df = spark.createDataFrame([(1, [["a"]])], "table_id int, grid array<array<string>>")
    with pytest.raises(S.PatternError):
        extract(df, "[ [EXT('bold') ? VAL : ()->REC] ]", ["$a_1"], bindings=Bindings().cell("bold", lambda c: c["bold"], whole=True), keep=False)


def test_merged_regions(spark):
    df = spark.createDataFrame([(1, [["a", "", "x"], ["", "", "y"], ["b", "c", "z"]], [(0, 0, 1, 1), (1, 1, 2, 1)]), (2, [["q"]], []), (3, None, None)], "t int, grid array<array<string>>, regions array<struct<top:int,left:int,bottom:int,right:int>>")
    got = {r.t: r.g for r in df.select("t", fill_merged(F.col("grid"), F.col("regions")).alias("g")).collect()}
    assert got == {1: [["a", "a", "x"], ["a", "a", "y"], ["b", "", "z"]], 2: [["q"]], 3: None}


SPLIT = "<SPLIT('/')> [ [VAL : 'A'->AVP, RT->REC] [VAL : 'B'->AVP] ]+"


def test_declared_widths_run_nothing(spark):
    df = spark.createDataFrame([(1, [["a/b", "c"], ["d", "e"]])], "table_id int, grid array<array<string>>")
    fails = df.select("table_id", F.when(F.raise_error("read").cast("boolean"), F.col("grid")).otherwise(F.col("grid")).alias("grid"))
    lazy = extract(fails, SPLIT, ["A", "B"], keep=False, widths={"A": 3})
    assert lazy.columns == ["table_id", "rec_no", "$a_1", "$a_2", "$a_3", "$a_4"]
    got = extract(df, SPLIT, ["A", "B"], keep=False, widths={"A": 3}).orderBy("rec_no").collect()
    assert [tuple(r)[2:] for r in got] == [("a", "b", "", "c"), ("d", "", "", "e")]
    assert extract(df, SPLIT, ["A", "B"], keep=False, widths={"A": 2}).drop("rec_no").exceptAll(extract(df, SPLIT, ["A", "B"], keep=False).drop("rec_no")).isEmpty()
    with pytest.raises(Exception, match="more than 1 parts"):
        extract(df, SPLIT, ["A", "B"], keep=False, widths={"B": 2}).collect()


def test_streams_have_one_schema(spark, tmp_path):
    tables = [(1, [["a/b", "c"]]), (2, [["d", "e"]])]
    df = spark.createDataFrame(tables, "table_id int, grid array<array<string>>")
    df.repartition(2, "table_id").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError, match="widths"):
        extract_stream(source, SPLIT, ["A", "B"], print, str(tmp_path / "check"))
    extract_stream(source, SPLIT, ["A", "B"], parquet_sink(str(tmp_path / "out")), str(tmp_path / "check"), widths={"A": 2}).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("table_id").collect()
    assert [tuple(r)[2:5] for r in got] == [("a", "b", "c"), ("d", "", "e")]


def test_inspection(spark):
    df = spark.createDataFrame([(1, [["a", "b,c"], ["d", ""]]), (2, [["x"]]), (None, None)], "table_id int, grid array<array<string>>")
    pattern = "'N'->AVP [ [VAL : ('q', RT)->REC] [(ATTR : LT->FILL){','}] ]+"
    got = {r.table_id: tuple(r)[1:] for r in inspected(df, pattern).collect()}
    assert got == {1: (True, (2, 2, 0), 6, 2), 2: (False, (0, 0, 0), 0, 0), None: (False, (0, 0, 0), 0, 0)}
