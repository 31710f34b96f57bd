"""Tables given row by row: the same records as from grids, whatever the chunks."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gridweave.operators import chunked
from gridweave.operators.chunked import Carried, extract_rows
from gridweave.operators.extract import extract
from gridweave.operators.match import Shape, match_grid
from gridweave.operators.rowmatch import ALPHABET, Automaton
from gridweave.plans import spec as S
from gridweave.plans.rtl import compile_pattern
from gridweave.sources.grids import read_csv_grids, read_csv_rows
from tests.test_rowmatch import random_pattern

CASES = {
    "[ [VAL : 'K'->AVP, RT*->REC] [VAL : 'V'->AVP] ]+": ["K", "V"],
    "[ [] [] ] [ [VAL : 'K'->AVP, RT->REC] [!BLANK ? VAL : 'V'->AVP | VAL = REPL('^$', '-') : 'V'->AVP] ]+": ["K", "V"],
    "{ [ ['h' ? VAL : 'H'->AVP] [] ] [ [!'h' ? VAL : 'K'->AVP, ST&R0*->REC] [(VAL : 'V'->AVP){','}] ]+ }+": ["K"],
    "{ [ ['h' ? VAL : 'H'->AVP] [] ] [ [!'h' ? VAL : 'K'->AVP, (RT, ST&'h')->REC] [VAL : 'V'->AVP] ]+ }+": ["H", "K", "V"],
    "[ [VAL : RT->REC] [VAL : -AV{2}->PREFIX('<')] ]+": ["$a_1", "$a_2"],
    "[ [VAL : RT->REC, (BW&STR)*->JOIN(0)] [VAL] ]+": [f"$a_{i}" for i in range(1, 20)],
    "[ ['h' ? VAL : 'K'->AVP, CL->REC | VAL : 'K'->AVP, CL->REC ] [AUX ':' AUX] ]+": ["K"],
}


@pytest.fixture(scope="module")
def grids():
    rng = random.Random(9)
    made = [[["h", ""], *([rng.choice(["a", "b", "h", "c"]), rng.choice(["", "x", "x,y", "p:q"])] for _ in range(rng.randint(1, 12)))] for _ in range(12)]
    made += [[["h", "x"], ["a", "y"], ["h", "z"]], [["a"]], [["a", "b", "c"]], [["h", "x:y"], ["k", "z:"]]]
    return made


@pytest.mark.parametrize("pattern", CASES)
@pytest.mark.parametrize("bits", [1, 12])
def test_same_as_grids(spark, grids, monkeypatch, pattern, bits):
    monkeypatch.setattr(chunked, "CHUNK_BITS", bits)
    rows = [(None if i == 3 else i, r, [None if x == "" and r % 2 else x for x in cells]) for i, g in enumerate(grids) for r, cells in enumerate(g)]
    df = spark.createDataFrame(rows, "t int, n int, c array<string>").repartition(3)
    got = extract_rows(df, pattern, CASES[pattern], table_id="t", row="n", cells="c", keep=False)
    tables = spark.createDataFrame([(None if i == 3 else i, g) for i, g in enumerate(grids)], "table_id int, grid array<array<string>>")
    want = extract(tables, pattern, CASES[pattern], keep=False)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert want.count() > 1 and extract_rows(df.where("false"), pattern, CASES[pattern], table_id="t", row="n", cells="c", keep=False).count() == 0


def test_states_by_the_rules():
    """What the automaton says of each row is what matching says, for patterns it accepts."""
    rng = random.Random(2)
    accepted = matched = 0
    while accepted < 150:
        try:
            shape = Shape(compile_pattern(random_pattern(rng)))
            automaton = Automaton(shape)
            carried = Carried(automaton)
        except S.PatternError:
            continue
        accepted += 1
        for _ in range(40):
            width = rng.randint(1, 2)
            grid = [[rng.randrange(automaton.classes) for _ in range(width)] for _ in range(rng.randint(1, 6))]
            state, new, states = ALPHABET[0], -1, []
            for row in grid:
                text = "".join(ALPHABET[x] for x in row)
                bits = sum(1 << i for i, (g, s) in enumerate(automaton.rows) if re.search(s.pattern, text) and all(x & g for x in row if g))
                state = carried.next[ALPHABET[bits]][carried.states.index(state)]
                new += state in carried.new
                states.append((new, state))
            want = match_grid(shape, grid)
            assert (want is not None) == (state in carried.accepting), grid
            if want is not None:
                matched += 1
                assert all(states[c["row"]][0] == c["subtable"] for c in want)
    assert matched > 200


def test_what_cannot_be_carried():
    for pattern in ("[ [VAL]+ ]+ [ [VAL] ]", "BLANK ? [ [VAL] ]+", "{ BLANK ? [ [VAL] ] }+"):
        with pytest.raises(S.PatternError):
            Carried(Automaton(Shape(compile_pattern(pattern))))
    assert Carried(Automaton(Shape(compile_pattern("{ [ [VAL] ] [ [AUX] ]{3} }+ "))))


def test_large_file(spark, tmp_path):
    """A file of many rows is never one row, and never one task's."""
    n = 200_000
    spark.range(n).select(F.format_string('%d,"v ""%d"""', "id", F.col("id") * 2).alias("value")).coalesce(1).write.text(str(tmp_path / "in"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    rows = read_csv_rows(spark, str(tmp_path / "in"))
    assert rows.rdd.getNumPartitions() > 3
    found = extract_rows(rows, "[ [VAL : 'K'->AVP, RT->REC] [VAL : 'V'->AVP] ]+", ["K", "V"], part="part", keep=False)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert "Python" not in found._jdf.queryExecution().toString()
    row = found.agg(F.count("*"), F.countDistinct("rec_no"), F.max("rec_no"), F.count_if(F.col("K") == F.col("rec_no")), F.count_if(F.col("V") == F.concat(F.lit('v "'), (F.col("rec_no") * 2).cast("string"), F.lit('"')))).first()
    assert tuple(row) == (n, n, n - 1, n, n)


def test_csv_rows_as_grids(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,"b,""c"\n\n,\n"",x\n')
    rows = read_csv_rows(spark, str(tmp_path)).orderBy("part", "row").collect()
    assert [r.cells for r in rows] == read_csv_grids(spark, str(tmp_path)).first().grid
