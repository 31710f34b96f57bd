"""Patterns and tables kept elsewhere: canonical texts, texts to reject, and tables with their records.

PATTERN_FIXTURES names a folder; without it nothing is tested here.  In it, at any depth:
ID.rtl with ID.expected.rtl (canonical text), */negative/NAME.rtl (rejected), and folders
task_NNN of input_K.csv and expected_K.csv, whose pattern is task_NNN.rtl.
"""

import csv
import json
import os
from collections import Counter
from pathlib import Path

import pytest

from gridweave.operators.extract import extract
from gridweave.operators.records import record_fields
from gridweave.plans import spec as S
from gridweave.plans.render import to_text
from gridweave.plans.rtl import compile_pattern
from gridweave.sources.grids import parse_csv

ROOT = os.environ.get("PATTERN_FIXTURES")
FILES = sorted(Path(ROOT).rglob("*")) if ROOT else []
POSITIVE = {p.name.removesuffix(".expected.rtl"): p for p in FILES if p.name.endswith(".expected.rtl")}
NEGATIVE = [p for p in FILES if p.suffix == ".rtl" and p.parent.name == "negative"]
COUNTS: Counter = Counter()
TASKS: dict[str, list[tuple[Path, Path]]] = {}
for _p in FILES:
    _other = _p.with_name(_p.name.replace("input_", "expected_"))
    if _p.name.startswith("input_") and _p.suffix == ".csv" and _other.exists() and _p.parent.name in POSITIVE:
        TASKS.setdefault(_p.parent.name, []).append((_p, _other))

pytestmark = pytest.mark.skipif(not ROOT, reason="PATTERN_FIXTURES isn't set")


def _text(path):
    return path.read_bytes().decode()


def _pattern(name):
    return _text(POSITIVE[name].with_name(name + ".rtl"))


@pytest.mark.parametrize("name", sorted(POSITIVE))
def test_canonical_text(name):
    assert to_text(compile_pattern(_pattern(name), permissive=True)) == _text(POSITIVE[name]).rstrip("\n")


@pytest.mark.parametrize("path", NEGATIVE, ids=lambda p: p.stem)
def test_rejected_text(path):
    with pytest.raises(S.PatternError):
        compile_pattern(_text(path))


def _alone(spark, name, given):
    """Attributes and records of one table."""
    tables = spark.createDataFrame([(0, parse_csv(_text(given)))], "table_id int, grid array<array<string>>")
    found = extract(tables, _pattern(name), keep=False, local_cells=None)
    return found.columns[2:], [tuple(x or "" for x in r[2:]) for r in sorted(found.collect(), key=lambda r: r.rec_no)]


def _together(spark, name, pattern):
    """Attributes and records of all tables of a pattern, in one plan: each table's attributes are those it has, as it meets them."""
    grids = [(i, parse_csv(_text(given))) for i, (given, _) in enumerate(TASKS[name])]
    rows = record_fields(spark.createDataFrame(grids, "table_id int, grid array<array<string>>"), pattern, keep=False, local_cells=None).collect()
    out = []
    for i in range(len(grids)):
        own = sorted((r for r in rows if r.table_id == i), key=lambda r: (r.visit, r.pos))
        names = list(dict.fromkeys(r.attr for r in own)) or ["$a_1"]
        records: dict[int, dict[str, str]] = {}
        for r in sorted(own, key=lambda r: (r.rec_no, r.pos)):
            records.setdefault(r.rec_no, {})[r.attr] = r.val or ""
        out.append((names, [tuple(rec.get(n, "") for n in names) for _, rec in sorted(records.items())]))
    return out


@pytest.mark.parametrize("name", sorted(TASKS))
def test_records_of_tables(spark, name):
    """All tables of a pattern go through in one plan, unless its settings change finished records."""
    pattern = compile_pattern(_pattern(name))
    made = [_alone(spark, name, given) for given, _ in TASKS[name]] if pattern.settings else _together(spark, name, pattern)
    for (given, expected), (names, got) in zip(TASKS[name], made, strict=True):
        options = json.loads((given.parent / "task_match_options.json").read_text("utf-8-sig")) if (given.parent / "task_match_options.json").exists() else {}
        rows = [r or [""] for r in csv.reader(expected.open(newline="", encoding="utf-8"))]
        if {x.strip() for x in rows[0]} == set(names):
            own = [x.strip() for x in rows[0]]
            assert own == names or options.get("attributeOrder") == "FLEXIBLE"
            order, rows = [own.index(n) for n in names], rows[1:]
        else:
            order = list(range(len(names)))
        want = [tuple(r[i] if i < len(r) else "" for i in order) for r in rows]
        assert Counter(got) == Counter(want) if options.get("recordOrder") == "FLEXIBLE" else got == want, given.name
        COUNTS["tables"] += 1
    COUNTS["tasks"] += 1
    print(f"tasks {COUNTS['tasks']} of {len(TASKS)}, tables {COUNTS['tables']} of {sum(map(len, TASKS.values()))}")
