"""Matching: which cell of a table is which cell of the pattern.

Tests of cells are evaluated once per cell as Columns and packed into one number.  Elements
are matched greedily and for good: an element that matched is never entered again, only the
number of repetitions of an element that isn't the last of its list is lowered, one by one.
A repetition of nothing ends the repetition.  Patterns that are regular are matched in the
JVM by regular expressions (module `rowmatch`); for others a small matcher per table works
on the numbers, and on texts only where a test calls Python.

Null cells count as empty strings; ragged tables, empty tables and null grids don't match.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridweave.functions import text as T
from gridweave.operators.rowmatch import CELLS, Automaton
from gridweave.plans import spec as S

_CELL = pa.struct([(k, pa.int32()) for k in ("row", "col", "leaf", "subtable", "subrow")])
MAX_TESTS = 62


def test_column(test: S.Test, text: Column) -> Column:
    """A test of a cell, or of an item's string, as a Column."""
    match test.kind:
        case "blank":
            found = T.is_blank(text)
        case "regex":
            found = T.matches(text, test.arg)
        case "contains":
            found = T.contains(text, test.arg)
        case "ext" if test.columnar:
            found = test.call(text)
        case _:
            raise S.PatternError(f"no Column for {test.kind}")
    return ~found if test.negated else found


class Shape:
    """A pattern reduced to what matching needs: numbers of tests and of leaf contents."""

    def __init__(self, table: S.Table, formatted: bool = False):
        self.formatted = formatted
        self.tests: list[S.Test] = []
        self.leaves: list[S.Atom | S.Delimited | S.Compound] = []
        self.guard = self._test(table.guard)
        self.subtables = tuple(self._subtable(t) for t in table.subtables)
        if len(self.tests) > MAX_TESTS:
            raise S.PatternError(f"a pattern has {MAX_TESTS} different tests at most")

    def _test(self, test: S.Test | None) -> int:
        if test is None:
            return 0
        if test not in self.tests:
            self.tests.append(test)
        return 1 << self.tests.index(test)

    def _leaf(self, content: S.Content | None):
        """The number of the leaf, -1 for none, or (test, then, other)."""
        if content is None or isinstance(content, S.Atom) and content.kind == S.SKIP:
            return -1
        if isinstance(content, S.Conditional):
            return self._test(content.test), self._leaf(content.then), self._leaf(content.other)
        self.leaves.append(content)
        return len(self.leaves) - 1

    def _cell(self, c: S.Cell):
        return self._test(c.guard), (c.times.low, c.times.high), self._leaf(c.content)

    def _subrow(self, s: S.Subrow):
        return self._test(s.guard), (s.times.low, s.times.high), tuple(map(self._cell, s.cells))

    def _row(self, r: S.Row):
        return self._test(r.guard), (r.times.low, r.times.high), tuple(map(self._subrow, r.subrows))

    def _subtable(self, t: S.Subtable):
        return self._test(t.guard), (t.times.low, t.times.high), tuple(map(self._row, t.rows))

    def numbers(self, grid: Column) -> Column:
        """The grid with each cell's tests packed into a number."""

        def of(cell: Column) -> Column:
            text = F.coalesce(cell["text"] if self.formatted else cell, F.lit(""))
            given = lambda t: cell if isinstance(t.call, S.Whole) else text
            if not self.formatted and any(isinstance(t.call, S.Whole) for t in self.tests):
                raise S.PatternError("a test of whole cells asks for cells that are structs")
            held = lambda t: F.coalesce(test_column(t, given(t)), F.lit(t.negated))
            bits = [F.when(held(t), 1 << i).otherwise(0).cast("long") for i, t in enumerate(self.tests) if not self._python(t)]
            return reduce(Column.bitwiseOR, bits, F.lit(0).cast("long"))

        return F.transform(grid, lambda row: F.transform(row, of))

    @staticmethod
    def _python(t: S.Test) -> bool:
        return t.kind == "ext" and not t.columnar

    @property
    def calls(self) -> list[tuple[int, Callable, bool]]:
        return [(1 << i, t.call, t.negated) for i, t in enumerate(self.tests) if self._python(t)]


def repeated(elements, one: Callable, at: int) -> tuple[int, list] | None:
    """Match a list of elements from a position; `one(element, at)` matches one once."""

    def rest(k: int, at: int) -> tuple[int, list] | None:
        low, high = elements[k][1]
        reached, found = [at], []
        while high is None or len(found) < high:
            step = one(elements[k], reached[-1])
            if step is None:
                break
            if step[0] == reached[-1]:
                low = 0  # it matches nothing, as often as is asked for
                break
            reached.append(step[0])
            found.append(step[1])
        if k == len(elements) - 1:
            return (reached[-1], found) if len(found) >= low else None
        for n in range(len(found), low - 1, -1):
            if (after := rest(k + 1, reached[n])) is not None:
                return after[0], found[:n] + after[1]
        return None

    return rest(0, at)


def match_grid(shape: Shape, grid: list[list[int]]) -> list[dict] | None:
    """The cells with a leaf, or None if the table doesn't match.  grid: the tests of each cell."""
    if not grid or not grid[0] or any(len(row) != len(grid[0]) for row in grid):
        return None
    width = len(grid[0])
    all_hold = lambda guard, rows: not guard or all(x & guard for row in rows for x in row)
    if not all_hold(shape.guard, grid):
        return None
    known: dict[tuple[int, int], tuple[int, list] | None] = {}

    def row(element, at: int):
        if at >= len(grid):
            return None
        key = (id(element), at)
        if key not in known:
            known[key] = row_once(element, grid[at], at)
        return known[key]

    def row_once(element, bits: list[int], at: int):
        if not all_hold(element[0], [bits]):
            return None

        def cell(e, col: int):
            if col >= width or e[0] and not bits[col] & e[0]:
                return None
            leaf = e[2]
            while not isinstance(leaf, int):
                leaf = leaf[1] if bits[col] & leaf[0] else leaf[2]
            return col + 1, (col, leaf)

        def subrow(e, col: int):
            found = repeated(e[2], cell, col)
            return found if found and all_hold(e[0], [bits[col : found[0]]]) else None

        found = repeated(element[2], subrow, 0)
        return (at + 1, (at, found[1])) if found and found[0] == width else None

    def subtable(element, at: int):
        found = repeated(element[2], row, at)
        return found if found and all_hold(element[0], grid[at : found[0]]) else None

    found = repeated(shape.subtables, subtable, 0)
    if not found or found[0] != len(grid):
        return None
    return [
        {"row": r, "col": c, "leaf": leaf, "subtable": t, "subrow": s}
        for t, rows in enumerate(found[1]) for r, subrows in rows for s, cells in enumerate(subrows) for c, leaf in cells if leaf >= 0
    ]


def _matcher(shape: Shape, calls):
    tests = Shape.__new__(Shape)
    tests.guard, tests.subtables = shape.guard, shape.subtables

    def numbered(numbers: pa.Array) -> pa.Array:
        return pa.array((match_grid(tests, grid) if grid else None for grid in numbers.to_pylist()), pa.list_(_CELL))

    def called(numbers: pa.Array, grids: pa.Array) -> pa.Array:
        out = []
        for grid, text in zip(numbers.to_pylist(), grids.to_pylist(), strict=True):
            if grid:
                grid = [[x | sum(bit for bit, call, negated in calls if bool(call(t or "")) != negated) for x, t in zip(a, b, strict=True)] for a, b in zip(grid, text, strict=True)]
            out.append(match_grid(tests, grid) if grid else None)
        return pa.array(out, pa.list_(_CELL))

    if not calls:
        return lambda numbers, grid: F.arrow_udf(numbered, CELLS)(numbers)
    return F.arrow_udf(called, CELLS)


def is_formatted(tables: DataFrame, grid: str) -> bool:
    """Whether a grid's cells are structs, with the text and what else there is to a cell."""
    kind = tables.schema[grid].dataType
    return isinstance(kind.elementType.elementType, StructType)


def cell_text(formatted: bool) -> Callable[[Column], Column]:
    return (lambda cell: cell["text"]) if formatted else (lambda cell: cell)


def match(tables: DataFrame, pattern: S.Table, grid: str = "grid", in_python: bool = False) -> DataFrame:
    """The tables with a column `cells`: the cells that have content and where in the pattern they are; null for tables that don't match.

    in_python: match regular patterns there, too.
    """
    shape = Shape(pattern, is_formatted(tables, grid))
    automaton = Automaton(shape)
    text_of = cell_text(shape.formatted)
    texts = F.transform(F.col(grid), lambda row: F.transform(row, text_of)) if shape.formatted else F.col(grid)
    if automaton.possible and not in_python:
        out = tables.withColumn("cells", automaton.cells(F.col(grid)))
    else:
        out = tables.withColumn("cells", _matcher(shape, shape.calls)(shape.numbers(F.col(grid)), texts))
    required = [(k, leaf) for k, leaf in enumerate(shape.leaves) if isinstance(leaf, S.Compound)]
    if required:
        # A text without one of its delimiters fails the whole table.
        text = lambda c: F.coalesce(text_of(F.get(F.get(F.col(grid), c["row"]), c["col"])), F.lit(""))
        fits = lambda c: reduce(lambda a, kv: a & ((c["leaf"] != kv[0]) | segments(text(c), kv[1])["ok"]), required, F.lit(True))
        out = out.withColumn("cells", F.when(F.forall("cells", fits), F.col("cells")))
    return out


def segments(text: Column, compound: S.Compound) -> Column:
    """Where each segment of a compound content lies in a text: struct of ok and places (from, to), code points.

    A segment follows its leading delimiter, found anywhere further on, and ends before the
    next delimiter, or with the text where that isn't found.  An empty delimiter takes no room.
    """
    marks = [lead for lead, _ in compound.segments]
    following = [*marks[1:], compound.close]
    steps = F.array(*(F.struct(F.lit(a).cast("string").alias("lead"), F.lit(b).cast("string").alias("next")) for a, b in zip(marks, following, strict=True)))
    start = F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok"), F.array().cast("array<struct<from:int,to:int>>").alias("places"))
    find = lambda mark, at: F.call_function("locate", mark, text, at + 1) - 1

    def one(state: Column, s: Column) -> Column:
        no_lead = s["lead"].isNull() | (s["lead"] == "")
        found = F.when(no_lead, state["at"]).otherwise(find(s["lead"], state["at"]))
        begin = found + F.coalesce(F.length(s["lead"]), F.lit(0))
        no_end = s["next"].isNull() | (s["next"] == "")
        stop = F.when(no_end, -1).otherwise(find(s["next"], begin))
        end = F.when(stop < 0, F.length(text)).otherwise(stop)
        place = F.struct(begin.cast("int").alias("from"), end.cast("int").alias("to"))
        after = F.when(s["next"] == "", begin).otherwise(end)
        return F.struct(after.cast("int").alias("at"), (state["ok"] & (found >= 0)).alias("ok"), F.concat(state["places"], F.array(place)).alias("places"))

    return F.aggregate(steps, start, one)
