"""Matching by regular expressions in the JVM: a character for each cell, one for each row.

A cell's tests, evaluated as Columns, pick a character, its class; a row's classes are a
string that regular expressions, one for each row of the pattern, match or don't.  Which of
them do picks the row's character, and the rows' characters are a string that one more
expression, the pattern's list of subtables, matches or doesn't.  Every list is an atomic
group, as are its elements; only counts of elements that aren't a list's last are lowered.

Which element took which cell is read off the groups' lengths.  A repeated group has one
match only, so the part of a string that all repetitions took is split by the element's own
expression, found again and again, and each find into its elements by their groups.

Not regular, and left to `match_grid`: tests that only Python can answer, guards of subrows
and subtables (they hold for what was taken, and decide afterwards), elements that may match
nothing, and patterns of more than CLASSES classes.  Repetitions of groups that may have to
be given back are left to it, too: the JVM's expressions do these by recursion, whose depth
is the number of repetitions; all others they do in a loop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Classes of cells, or of rows, at most: a character each.
CLASSES = 256
_PLAIN = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ALPHABET = _PLAIN + "".join(chr(0x4E00 + i) for i in range(CLASSES - len(_PLAIN)))
CELLS = "array<struct<row:int,col:int,leaf:int,subtable:int,subrow:int>>"
#: A count up to which a repetition that may be given back is written out.
_COUNTED = 64


def _bound(value: Column, then) -> Column:
    """An expression of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _times(times: tuple[int, int | None], last: bool) -> str:
    low, high = times
    if times == (1, 1):
        return ""
    text = {(0, 1): "?", (0, None): "*", (1, None): "+"}.get(times) or (f"{{{low},}}" if high is None else f"{{{low}}}" if low == high else f"{{{low},{high}}}")
    return text + ("+" if last else "")


class Units:
    """An element of a list, itself a list of units: each a class of characters, repeated."""

    def __init__(self, times: tuple[int, int | None], units: list[tuple[tuple[int, int | None], str, int]]):
        self.times, self.units = times, units

    @property
    def single(self) -> bool:
        return len(self.units) == 1 and self.units[0][0] == (1, 1)

    def pattern(self, groups: bool = False) -> str:
        """The expression of the element once; with a group for each unit."""
        one = [f"[{chars}]{_times(times, i == len(self.units) - 1)}" for i, (times, chars, _) in enumerate(self.units)]
        if groups:
            return "^(?>" + "".join(f"({x})" for x in one) + ")"
        return one[0] if self.single else "(?>" + "".join(one) + ")"

    def regular(self, last: bool) -> bool:
        if all(low == 0 for (low, _), *_ in self.units) or any(not chars for _, chars, _ in self.units):
            return False
        return last or self.single or self.times[1] is not None and self.times[1] <= _COUNTED


class Sequence:
    """A list of elements that must take a whole string."""

    def __init__(self, elements: list[Units]):
        self.elements = elements

    @property
    def regular(self) -> bool:
        return all(e.regular(i == len(self.elements) - 1) for i, e in enumerate(self.elements)) and any(e.times[0] for e in self.elements)

    @property
    def pattern(self) -> str:
        last = len(self.elements) - 1
        return "^(?>" + "".join(f"({e.pattern()}{_times(e.times, i == last)})" for i, e in enumerate(self.elements)) + ")$"

    def taken(self, text: Column) -> Column:
        """For each character the number of the unit that took it (`unit`) and of the repetition, over all elements (`nth`)."""
        if all(e.times == (1, 1) and all(times == (1, 1) for times, *_ in e.units) for e in self.elements):
            # Each unit takes one character, whatever the string that matched.
            units = [(unit, nth) for nth, e in enumerate(self.elements) for *_, unit in e.units]
            return F.array(*(F.struct(F.lit(unit).alias("unit"), F.lit(nth).alias("nth")) for unit, nth in units))
        alone = len(self.elements) == 1
        finds = []
        for i, e in enumerate(self.elements):
            part = text if alone else F.regexp_extract(text, self.pattern, i + 1)
            each = F.array(part) if e.times == (1, 1) else F.regexp_extract_all(part, F.lit(e.pattern()), F.lit(0))
            finds.append(_numbered(each, i))

        def split(find: Column, nth: Column) -> Column:
            def of(e: Units) -> Column:
                lengths = [F.length(find["text"])] if len(e.units) == 1 else [F.length(F.regexp_extract(find["text"], e.pattern(groups=True), j + 1)) for j in range(len(e.units))]
                return F.concat(*(F.array_repeat(F.struct(F.lit(unit).alias("unit"), nth.cast("int").alias("nth")), n) for (_, _, unit), n in zip(e.units, lengths, strict=True)))

            first, *others = [(i, of(e)) for i, e in enumerate(self.elements)]
            return reduce(lambda a, ie: a.when(find["element"] == ie[0], ie[1]), others, F.when(find["element"] == first[0], first[1])) if others else first[1]

        return F.flatten(F.transform(F.concat(*finds), split))


def _numbered(texts: Column, element: int) -> Column:
    return F.transform(texts, lambda s: F.struct(F.lit(element).alias("element"), s.alias("text")))


def _chars(n: int, holds) -> str:
    return "".join(ALPHABET[i] for i in range(n) if holds(i))


class Automaton:
    """The expressions of a pattern's shape."""

    def __init__(self, shape):
        self.shape = shape
        self.classes = 1 << len(shape.tests)
        self.leaves: list[object] = []
        self.rows: list[tuple[int, Sequence]] = []
        self.possible = not shape.calls and self.classes <= CLASSES
        if not self.possible:
            return
        guards = [t[0] for t in shape.subtables] + [s[0] for t in shape.subtables for r in t[2] for s in r[2]]
        number = {}
        for t in shape.subtables:
            for r in t[2]:
                number[id(r)] = len(self.rows)
                self.rows.append((r[0], Sequence([Units(s[1], [(c[1], _chars(self.classes, lambda x, c=c: not c[0] or x & c[0]), self._leaf(c[2])) for c in s[2]]) for s in r[2]])))
        self.possible = not any(guards) and 1 << len(self.rows) <= CLASSES
        if not self.possible:
            return
        rows = 1 << len(self.rows)
        self.table = Sequence([Units(t[1], [(r[1], _chars(rows, lambda x, r=r: x >> number[id(r)] & 1), number[id(r)]) for r in t[2]]) for t in shape.subtables])
        self.possible = self.table.regular and all(s.regular for _, s in self.rows)

    def _leaf(self, leaf) -> int:
        self.leaves.append(leaf)
        return len(self.leaves) - 1

    def _class_of(self, numbers: Column) -> Column:
        """A row's string: the character of each cell's number."""
        if self.classes == 1:
            return F.repeat(F.lit(ALPHABET[0]), F.size(numbers))
        letters = F.lit(ALPHABET[: self.classes])
        return F.array_join(F.transform(numbers, lambda n: F.substring(letters, n.cast("int") + 1, F.lit(1))), "")

    def row_number(self, text: Column) -> Column:
        """Which rows of the pattern a row's string can be, as bits of a number."""

        def hold(guard: int, sequence: Sequence) -> Column:
            own = text.rlike(sequence.pattern)
            return own & text.rlike(f"^[{_chars(self.classes, lambda x: x & guard)}]*$") if guard else own

        bits = [F.when(hold(g, s), 1 << i).otherwise(0) for i, (g, s) in enumerate(self.rows)]
        return reduce(Column.__add__, bits)

    def row_class(self, text: Column) -> Column:
        return F.substring(F.lit(ALPHABET[: 1 << len(self.rows)]), self.row_number(text) + 1, F.lit(1))

    def _leaf_of(self, unit: Column, char: Column) -> Column:
        """What a unit makes of a cell of a class: the number of its leaf, -1 for none."""

        def resolved(leaf, bits: int) -> int:
            while not isinstance(leaf, int):
                leaf = leaf[1] if bits & leaf[0] else leaf[2]
            return leaf

        def of(leaf) -> Column:
            if isinstance(leaf, int):
                return F.lit(leaf)
            return F.get(F.array(*(F.lit(resolved(leaf, i)) for i in range(self.classes))), F.instr(F.lit(ALPHABET[: self.classes]), char) - 1)

        constant = F.get(F.array(*(F.lit(x if isinstance(x, int) else -1) for x in self.leaves)), unit)
        return reduce(lambda a, nx: F.when(unit == nx[0], of(nx[1])).otherwise(a), [(n, x) for n, x in enumerate(self.leaves) if not isinstance(x, int)], constant)

    def row_cells(self, text: Column, row: Column, at: Column) -> Column:
        """The cells of a row (unit, nth) with the classes `text`, those without a leaf too."""
        first, *others = [(i, s.taken(text)) for i, (_, s) in enumerate(self.rows)]
        taken = reduce(lambda a, ie: a.when(row["unit"] == ie[0], ie[1]), others, F.when(row["unit"] == first[0], first[1])) if others else first[1]
        return F.transform(taken, lambda c, col: F.struct(
            at.cast("int").alias("row"), col.cast("int").alias("col"), self._leaf_of(c["unit"], F.substring(text, col + 1, F.lit(1))).cast("int").alias("leaf"),
            row["nth"].alias("subtable"), c["nth"].alias("subrow"),
        ))

    def classes_of_row(self, cells: Column) -> Column:
        """The string of one row's cells."""
        return self._class_of(F.get(self.shape.numbers(F.array(cells)), F.lit(0)))

    def cells(self, grid: Column) -> Column:
        """The cells with a leaf, in order; null if the table doesn't match."""
        width = F.size(F.get(grid, F.lit(0)))
        even = grid.isNotNull() & (F.size(grid) > 0) & (width > 0) & F.forall(grid, lambda row: row.isNotNull() & (F.size(row) == width))
        guard = self.shape.guard
        all_hold = (lambda texts: F.forall(texts, lambda t: t.rlike(f"^[{_chars(self.classes, lambda x: x & guard)}]*$"))) if guard else None

        def of_texts(texts: Column) -> Column:
            def of_table(table: Column) -> Column:
                found = F.flatten(F.transform(self.table.taken(table), lambda row, at: _bound(F.get(texts, at), lambda text: self.row_cells(text, row, at))))
                return F.when(table.rlike(self.table.pattern), F.filter(found, lambda c: c["leaf"] >= 0))

            matched = _bound(F.array_join(F.transform(texts, self.row_class), ""), of_table)
            return F.when(all_hold(texts), matched) if all_hold else matched

        texts = F.transform(self.shape.numbers(grid), self._class_of)
        return F.when(even, _bound(texts, of_texts)).cast(CELLS)
