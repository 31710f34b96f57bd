"""Rows with numbers far apart, and single lookups along a line."""

from pyspark.sql import functions as F

from gridweave.operators import chunked
from gridweave.operators.extract import extract
from gridweave.operators.match import Shape
from gridweave.operators.rowmatch import Automaton
from gridweave.plans.rtl import compile_pattern


def test_chunks_are_of_rows_not_of_numbers(spark):
    """Five thousand rows are a few chunks, however far apart their numbers are (before: one for each 4,096 numbers)."""
    rows = spark.range(5000).select(F.struct(F.lit(1).alias("id")).alias("table_id"), F.lit(0).cast("long").alias("part"), (F.col("id") * 1_000_000).alias("row"), F.array(F.lit("a")).alias("cells"))
    automaton = Automaton(Shape(compile_pattern("[ [VAL : RT*->REC] ]+")))
    sizes = [r.n for r in chunked._chunks(rows, automaton, chunked.Carried(automaton)).select(F.size("rows").alias("n")).collect()]
    assert sum(sizes) == 5000 and max(sizes) <= 1 << chunked.CHUNK_BITS and len(sizes) < 20


def test_one_item_elsewhere_on_a_line(spark):
    """By running minima as by arrays: before or behind the anchor, both ways round, several items in a cell."""
    grids = spark.createDataFrame([(1, [["a b", "c", "x"], ["d", "e f", "y"], ["g", "h", "x"]]), (2, [["q", "q q", "q"]])], "table_id int, grid array<array<string>>")
    pattern = "[ [(VAL : (ROW, -ROW, ST, -ST, COL, -COL, ROW&'[c-h]', -COL&'[a-d]', AV, -BW)->REC){' '}] [(VAL #'t'){' '}] [VAL : (ST&#'t', -ST&#'t')->REC] ]+"
    names = [f"$a_{i}" for i in range(1, 13)]
    found = [sorted(map(repr, extract(grids, pattern, names, local_cells=n).collect())) for n in (None, 0)]
    assert found[0] == found[1] and len(found[0]) == 9
