"""Tables of many rows: what is gathered of them, and sections that their numbers don't set apart."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from gridweave.operators import chunked
from gridweave.operators.chunked import extract_rows, layouts_of
from gridweave.operators.extract import extract
from gridweave.operators.items import Atoms
from gridweave.operators.match import Shape
from gridweave.operators.records import told_members
from gridweave.plans.rtl import compile_pattern

SECTIONS = """{ [ ['h' ? VAL#'h' : 'H'->AVP] [VAL#'t' : 'T'->AVP] ]
    [ [!'h' ? VAL : 'K'->AVP, (ST&#'t', ROW&#'v', -ST&#'h')->REC] [VAL#'v' : 'V'->AVP] ]+ }+"""


def arguments(plan: str, function: str) -> list[str]:
    """What stands within the parentheses of a function, wherever it is called."""
    out = []
    for part in plan.split(f"{function}(")[1:]:
        depth = 1
        for i, c in enumerate(part):
            depth += (c == "(") - (c == ")")
            if not depth:
                out.append(part[:i])
                break
    return out


def test_no_cells_are_gathered(spark):
    """However many rows a chunk has, and however long their cells: of these no task holds a list."""
    rows = spark.range(1000).select(F.lit(1).alias("t"), "id", F.array(F.when(F.col("id") % 10 == 0, "h").otherwise("k"), F.repeat(F.lit("x"), 100)).alias("cells"))
    found = extract_rows(rows, SECTIONS, ["K", "V", "H", "T"], table_id="t", row="id")
    assert found.agg(F.count("*"), F.count_if(F.length("V") == 100), F.count_if(F.col("H") == "h")).first() == (900, 900, 900)
    gathered = arguments(found._jdf.queryExecution().toString(), "collect_list")
    spark.catalog.clearCache()
    assert gathered and not any("cells" in x for x in gathered)


@pytest.mark.parametrize("bits", [1, 10])
def test_sections_as_grids(spark, monkeypatch, bits):
    monkeypatch.setattr(chunked, "CHUNK_BITS", bits)
    pattern = compile_pattern(SECTIONS)
    assert layouts_of(Shape(pattern)) and told_members(Atoms(pattern).atoms)
    rng = random.Random(4)
    grids = [[["h", "q"], *([rng.choice("abch"), rng.choice("xyz")] for _ in range(rng.randint(1, 20)))] for _ in range(40)]
    grids = [[r for r, after in zip(g, [*g[1:], ["h"]], strict=True) if r[0] != "h" or after[0] != "h"] for g in grids]
    grids += [[["h", "x"], ["h", "y"], ["a", "z"]], [["a", "b"]], [["h", "x"], ["a"]], [["h", "x"], ["a", None]]]
    rows = spark.createDataFrame([(i, r, cells) for i, g in enumerate(grids) for r, cells in enumerate(g)] + [(99, 0, None), (99, 1, ["h", "x"])], "table_id int, row int, cells array<string>").repartition(3)
    schema = ["K", "V", "H", "T"]
    got = extract_rows(rows, SECTIONS, schema)
    want = extract(spark.createDataFrame(list(enumerate(grids)), "table_id int, grid array<array<string>>"), SECTIONS, schema)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert want.count() > 100
    spark.catalog.clearCache()


@pytest.mark.parametrize("line", ["SR", "SC", "ROW", "COL", "ST", "NCL"])
def test_first_elsewhere(spark, line):
    """The first item in any other cell of a line, in each order: as rows what it is as arrays."""
    pattern = f"{{ [ [VAL#'a' : 'A'->AVP, ({line}, -({line}), ^({line}&#'b'), -^({line}&#'a'))->REC] [VAL#'b'] [VAL] ]{{2}} }}+"
    rng = random.Random(5)
    grids = [(i, [[rng.choice("pqr") for _ in range(3)] for _ in range(2 * rng.randint(1, 3))]) for i in range(30)]
    tables = spark.createDataFrame(grids, "table_id int, grid array<array<string>>")
    made = [sorted(map(str, extract(tables, pattern.replace("'A'->AVP, ", ""), [f"$a_{i}" for i in range(1, 6)], local_cells=n).collect())) for n in (64, 0)]
    assert made[0] == made[1] and len(made[0]) > 60
    spark.catalog.clearCache()


@pytest.mark.parametrize("case", ["two statuses", "many lines", "repeated orders"])
def test_odd_orders(spark, tmp_path, case):
    """An order of two statuses is two sections, one of thousands of lines is one, one that is there twice gives its lines twice."""
    orders = [(i, i % 7 if i % 5 else None, "FO"[i % 2]) for i in range(40)]
    lines = [(i, n, 10 * i + n) for i in range(50) if i % 4 != 3 for n in range(1, 4)]
    orders += {"two statuses": [(9, 9 % 7, "P"), (9, 9 % 7, "F")], "many lines": [], "repeated orders": [(9, 9 % 7, "O"), (12, 3, "F")]}[case]
    lines += [(9, n, n) for n in range(1, 9000)] if case == "many lines" else []
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = __spark_entry__.queries()["sections"](spark, str(tmp_path))
    duck = duckdb.connect()
    for t in ("orders", "lineitem"):
        duck.sql(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = duck.sql(__spark_entry__.oracle_sql()["sections"])
    assert sorted(map(str, (tuple(r) for r in got.select(want.columns).collect()))) == sorted(map(str, want.fetchall()))
    spark.catalog.clearCache()
