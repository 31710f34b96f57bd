"""Extraction from tables larger than a row: a table is many rows (table_id, part, row, cells).

A row's cells give its class without looking at other rows.  The pattern's list of subtables
is an automaton over these classes; its transition table for a chunk of rows, from every
state at once, needs no other chunk.  The chunks' tables are put together in order, which
says in what state each chunk begins, and then each chunk's rows are placed by themselves.
Of a whole table only the chunks' transition tables meet in one row, some bytes each; of a
chunk's rows only numbers do, while the rows with their cells stay rows, and meet what is
known of their chunk by a join.

A pattern whose lookups all stay within a row is worked on row by row; the items of others
are dealt by table as in `records`, and by line where all lookups keep to one, and sorted
and carried along there.  Rows and chunks are persisted on disk, whatever `keep` says.

Only patterns that say at each row what it is can be carried so (`Carried`): where a row
could be one more of an element that may be given back or the next element, the decision is
made by rows to come, and PatternError says so.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.operators import local
from gridweave.operators import records as R
from gridweave.operators.extract import wide, wide_members
from gridweave.operators.items import STRIDE, Atoms, arrays_of, items_of, leaf_items
from gridweave.operators.match import Shape, segments, test_column
from gridweave.operators.rowmatch import ALPHABET, CELLS, Automaton
from gridweave.operators.transforms import applied
from gridweave.plans import spec as S
from gridweave.plans.rtl import Bindings, compile_pattern

#: Rows to a chunk at most, as a power of two.
CHUNK_BITS = 10
MAX_STATES = 120
#: States' letters: the start, none, then positions.
_START, _DEAD = ALPHABET[0], ALPHABET[1]


class Carried:
    """The automaton of a pattern's list of subtables.

    A state is a position of the pattern, a row element, and whether a row that reaches it
    begins a subtable.
    """

    def __init__(self, automaton: Automaton):
        if not automaton.possible or automaton.shape.guard:
            raise S.PatternError("only a regular pattern without a guard of the table can be carried from row to row")
        self.rows = 1 << len(automaton.rows)
        # Positions: (chars, unit); first and last ones of each stretch, and what may follow.
        self.positions: list[tuple[frozenset, int]] = []
        self.edges: list[list[tuple[int, bool, int]]] = []
        # Ranks: within an element, its last unit's repetitions and what else goes on there; then the last
        # element's repetitions; then other repetitions and the next element.
        elements = automaton.table.elements
        first, last, empty = self._sequence([self._element(e, i == len(elements) - 1) for i, e in enumerate(elements)], True, 3)
        if len(self.positions) * 2 + 2 > MAX_STATES:
            raise S.PatternError("the pattern has too many row elements to be carried from row to row")
        state = lambda p, new: ALPHABET[2 + 2 * p + new]
        self.states = _START + _DEAD + "".join(state(p, n) for p in range(len(self.positions)) for n in (0, 1))
        self.accepting = "".join(state(p, n) for p in last for n in (0, 1)) + (_START if empty else "")
        self.new = "".join(state(p, 1) for p in range(len(self.positions)))
        self.unit = {state(p, n): self.positions[p][1] for p in range(len(self.positions)) for n in (0, 1)}
        start = self._choices([(p, True, 1) for p in first])
        moves = [self._choices(e) for e in self.edges]
        self.next: dict[str, str] = {}
        for c in ALPHABET[: self.rows]:
            to = lambda m: state(*m[c]) if c in m else _DEAD  # noqa: B023, E731
            self.next[c] = to(start) + _DEAD + "".join(to(m) for m in moves for _ in (0, 1))

    def _choices(self, edges: list[tuple[int, bool, int]]) -> dict[str, tuple[int, int]]:
        """Character -> (position, new).  Of edges for one character that of the least rank is taken; equal ranks can't be told apart."""
        out: dict[str, tuple[int, int, int]] = {}
        for p, new, rank in edges:
            for c in self.positions[p][0]:
                if c in out and out[c][2] == rank and out[c][:2] != (p, int(new)):
                    raise S.PatternError("rows to come decide what a row is: the pattern can't be carried from row to row")
                if c not in out or rank < out[c][2]:
                    out[c] = (p, int(new), rank)
        return {c: x[:2] for c, x in out.items()}

    def _link(self, last: list[int], first: list[int], new: bool, rank: int) -> None:
        for p in last:
            self.edges[p] += [(q, new, rank) for q in first]

    def _times(self, one, times: tuple[int, int | None], new: bool, rank: int) -> tuple[list[int], list[int], bool]:
        """Repetitions of `one()`, which makes positions: the first and last ones, and whether there may be none."""
        low, high = times
        parts = [one() for _ in range(max(low, 1) if high is None else high)]
        first, last, empty = [], [], True
        for i, (f, l) in enumerate(parts):
            self._link(last, f, new, rank)
            first += f if empty else []
            last = (last if i >= low else []) + l
            empty = empty and i >= low
        if high is None:
            self._link(parts[-1][1], parts[-1][0], new, rank)
        return first, last, empty

    def _element(self, e, final: bool):
        def unit(chars: str, number: int):
            def one() -> tuple[list[int], list[int]]:
                self.positions.append((frozenset(chars), number))
                self.edges.append([])
                return [len(self.positions) - 1], [len(self.positions) - 1]

            return one

        def once() -> tuple[list[int], list[int]]:
            made = [self._times(unit(chars, number), times, False, 0 if i == len(e.units) - 1 else 1) for i, (times, chars, number) in enumerate(e.units)]
            return self._sequence(made, False, 1)[:2]

        return self._times(once, e.times, True, 2 if final else 3)

    def _sequence(self, parts, new: bool, rank: int):
        first, last, empty = [], [], True
        for f, l, e in parts:
            self._link(last, f, new, rank)
            first += f if empty else []
            last = (last if e else []) + l
            empty = empty and e
        return first, last, empty

    def step(self, state: Column, code: Column) -> Column:
        """The next states of a string of states, by a row's number."""
        return F.call_function("translate", state, F.lit(self.states), F.get(F.array(*(F.lit(self.next[c]) for c in ALPHABET[: self.rows])), code))


#: A row's number and its place in a chunk are one number; no pattern has so many kinds of rows.
_CODES = 256
#: So is what is known of a row: the number of its row element, of which there are fewer, and the subtables begun so far.
_UNITS = 8


def layouts_of(shape: Shape) -> list[list[tuple[int, int, int]]] | None:
    """The cells (tests, leaf, subrow) of each row of the pattern; None if any may be repeated or left out, or has its content by a test."""
    out = []
    for r in (r for t in shape.subtables for r in t[2]):
        if any(s[1] != (1, 1) or any(c[1] != (1, 1) or not isinstance(c[2], int) for c in s[2]) for s in r[2]):
            return None
        out.append([(r[0] | c[0], c[2], n) for n, s in enumerate(r[2]) for c in s[2]])
    return None if any(isinstance(t.call, S.Whole) for t in shape.tests) else out


def _text(col: int) -> Column:
    return F.coalesce(F.get("cells", F.lit(col)), F.lit(""))


def _row_number(shape: Shape, layouts: list[list[tuple[int, int, int]]]) -> Column:
    """What Automaton.row_number gives, by the tests that a row's cells must meet each."""

    def hold(cells: list[tuple[int, int, int]]) -> Column:
        tests = [F.coalesce(test_column(t, _text(col)), F.lit(t.negated)) for col, (own, *_) in enumerate(cells) for i, t in enumerate(shape.tests) if own >> i & 1]
        return reduce(Column.__and__, tests, F.size("cells") == len(cells))

    return reduce(Column.__add__, (F.when(hold(cells), 1 << i).otherwise(0) for i, cells in enumerate(layouts)))


def _by_unit(each: list[Column]) -> Column:
    return reduce(lambda a, ie: a.when(F.col("unit") == ie[0], ie[1]), list(enumerate(each))[1:], F.when(F.col("unit") == 0, each[0]))


def _laid_out(layouts: list[list[tuple[int, int, int]]]) -> Column:
    """What Automaton.row_cells gives, but for cells without a leaf."""
    cell = lambda col, leaf, subrow: F.struct(F.lit(0).alias("row"), F.lit(col).alias("col"), F.lit(leaf).alias("leaf"), F.col("subtable"), F.lit(subrow).alias("subrow"))
    return _by_unit([F.array(*(cell(col, leaf, subrow) for col, (_, leaf, subrow) in enumerate(cells) if leaf >= 0)).cast(CELLS) for cells in layouts])


def _items(matched: DataFrame, layouts: list[list[tuple[int, int, int]]], pattern: S.Table) -> DataFrame:
    """The items of rows, each row's in one array."""
    atoms = Atoms(pattern)
    kind = "array<struct<col:int,n:int,atom:int,idx:int,s:string,subrow:int>>"

    def of_cell(col: int, leaf: int, subrow: int) -> Column:
        own = leaf_items(_text(col), leaf, atoms.leaves[leaf], atoms, False)
        item = lambda x, n: F.struct(F.lit(col).alias("col"), n.alias("n"), *(x[c].alias(c) for c in ("atom", "idx", "s")), F.lit(subrow).alias("subrow"))
        return F.array(item(own[0], F.lit(0))) if isinstance(atoms.leaves[leaf], S.Atom) else F.transform(own, item)

    def of_row(cells: list[tuple[int, int, int]]) -> Column:
        own = [of_cell(col, leaf, subrow) for col, (_, leaf, subrow) in enumerate(cells) if leaf >= 0]
        return F.concat(*own).cast(kind) if own else F.array().cast(kind)

    each = matched.select("table_id", "number", "subtable", F.size("cells").alias("width"), F.explode(_by_unit(list(map(of_row, layouts)))).alias("i"))
    place = F.col("number") * F.col("width") + F.col("i.col")
    return each.select("table_id", (place * STRIDE + F.col("i.n")).alias("seq"), "i.atom", "i.idx", "i.s", F.col("number").cast("int").alias("row"), "i.col", "subtable", "i.subrow")


def _rows(rows: DataFrame, automaton: Automaton) -> DataFrame:
    """(table_id, chunk, at, code, cells): the rows in order, each with its chunk and its place there; with `text`, the cells' classes, if the pattern's rows don't tell their cells."""
    # Chunks are of rows that follow each other, however far apart their numbers are: dealt by ranges, a row's place is its partition's and its own.
    ranged = rows.repartitionByRange("table_id", "part", "row").sortWithinPartitions("table_id", "part", "row", "cells")
    placed = ranged.select("table_id", F.monotonically_increasing_id().alias("place"), "cells")
    layouts = layouts_of(automaton.shape)
    text = [] if layouts else ["text"]
    placed = placed if layouts else placed.withColumn("text", automaton.classes_of_row(F.col("cells")))
    code = _row_number(automaton.shape, layouts) if layouts else automaton.row_number(F.col("text"))
    at = F.col("place").bitwiseAND((1 << CHUNK_BITS) - 1).cast("int")
    return placed.select("table_id", F.shiftright("place", CHUNK_BITS).alias("chunk"), at.alias("at"), code.alias("code"), "cells", *text)


def _chunks(rows: DataFrame, automaton: Automaton, carried: Carried) -> DataFrame:
    """(table_id, chunk, first, rows, moves, least, most): of a chunk's rows, as given or as `_rows` gives them, only the numbers, in order, and where these lead from each state."""
    each = rows if "code" in rows.columns else _rows(rows, automaton)
    packed = F.sort_array(F.collect_list(F.col("at") * _CODES + F.col("code")))
    width = F.size("cells")
    found = each.groupBy("table_id", "chunk").agg(F.min("at").alias("first"), packed.alias("packed"), F.min(width).alias("least"), F.max(width).alias("most"))
    numbers = found.select("table_id", "chunk", "first", F.transform("packed", lambda c: (c % _CODES).cast("int")).alias("rows"), "least", "most")
    return numbers.withColumn("moves", F.aggregate("rows", F.lit(carried.states), carried.step))


def _chunks_begun(chunks: DataFrame, carried: Carried) -> DataFrame:
    """(table_id, chunk, start): in what state each chunk of a table that matches begins."""
    tables = chunks.groupBy("table_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "moves", "least", "most"))).alias("chunks"))
    after = lambda state, moves: F.substring(moves, F.instr(F.lit(carried.states), state), F.lit(1))
    begin = F.struct(F.lit(_START).alias("state"), F.lit("").alias("starts"))
    carry = F.aggregate("chunks", begin, lambda a, c: F.struct(after(a["state"], c["moves"]).alias("state"), F.concat(a["starts"], a["state"]).alias("starts")))
    even = (F.array_min(F.transform("chunks", lambda c: c["least"])) == F.array_max(F.transform("chunks", lambda c: c["most"]))) & (F.col("chunks")[0]["least"] > 0)
    matched = tables.withColumn("carry", carry).where(even & F.col("carry.state").isin(list(carried.accepting)))
    return matched.select("table_id", "carry.starts", F.posexplode("chunks").alias("k", "c")).select("table_id", "c.chunk", F.substring("starts", F.col("k") + 1, F.lit(1)).alias("start"))


def _known(states: Column, carried: Carried) -> Column:
    """For each letter of a string of states: how many subtables began so far, and the row element."""
    begun = F.regexp_extract_all(states, F.lit(f"^[^{carried.new}]+|[{carried.new}][^{carried.new}]*"), F.lit(0))
    lead = F.when(states.rlike(f"^[{carried.new}]"), 1).otherwise(0)
    so_far = F.flatten(F.transform(begun, lambda s, k: F.array_repeat(k + lead, F.length(s))))
    units = F.translate(states, "".join(carried.unit), "".join(map(str, carried.unit.values())))
    return F.zip_with(so_far, F.regexp_extract_all(units, F.lit("."), F.lit(0)), lambda n, unit: n * _UNITS + unit.cast("int"))


def placed_rows(rows: DataFrame, pattern: S.Table) -> DataFrame:
    """(table_id, chunk, number, unit, subtable, cells, and `text` as in _rows): the rows of tables that match, numbered from 0, and what each is."""
    automaton = Automaton(Shape(pattern))
    carried = Carried(automaton)
    # Persisted, as ranges found anew may be others.  On disk, as these are all rows: memory is for what sorts and joins them.
    each = _rows(rows, automaton).persist(StorageLevel.DISK_ONLY)
    chunks = _chunks(each, automaton, carried).persist(StorageLevel.DISK_ONLY)
    states = F.aggregate("rows", F.struct(F.col("start").alias("state"), F.lit("").alias("all")), lambda a, c: _then(carried.step(a["state"], c), a), lambda a: a["all"])
    begun = chunks.join(_chunks_begun(chunks, carried), ["table_id", "chunk"]).withColumn("states", states)
    known = begun.select("table_id", "chunk", "first", _known(F.col("states"), carried).alias("known")).persist(StorageLevel.DISK_ONLY)
    before = Window.partitionBy("table_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    news = F.shiftright(F.element_at("known", -1), _UNITS.bit_length() - 1)
    sizes = known.select("table_id", "chunk", F.size("known").cast("long").alias("n"), news.cast("long").alias("news"))
    offsets = sizes.select("table_id", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("news").over(before), F.lit(0)).alias("news_before"))
    # Chunks are hashed, so that rows meet them unsorted: some bytes for each row of a partition.
    placed = each.drop("code").join(known.join(offsets, ["table_id", "chunk"]).hint("shuffle_hash"), ["table_id", "chunk"])
    i = F.col("at") - F.col("first")
    own = F.get("known", i)
    return placed.select(
        "table_id", "chunk", (F.col("rows_before") + i).alias("number"), (own % _UNITS).alias("unit"),
        (F.col("news_before") + F.shiftright(own, _UNITS.bit_length() - 1) - 1).cast("int").alias("subtable"), "cells", *(c for c in each.columns if c == "text"),
    )


def _then(state: Column, a: Column) -> Column:
    return F.element_at(F.transform(F.array(state), lambda s: F.struct(s.alias("state"), F.concat(a["all"], s).alias("all"))), 1)


_IN_ROW = ("LT", "RT", "SR", "ROW", "CL")


def within_rows(pattern: S.Table, options: R.Options) -> bool:
    """Whether no record depends on more than one row, and names are the pattern's own."""
    atoms = Atoms(pattern).atoms
    actions = [x for a in atoms for x in a.actions]
    lookups = [p for x in actions for p in x.providers if isinstance(p, S.Lookup)]
    rows = all(any(isinstance(t, S.Spatial) and t.name in _IN_ROW for t in b) and not any(isinstance(t, S.Place) and t.axis == "R" for t in b) for p in lookups for b in p.condition)
    return rows and options.actions_by == "row" and not any(x.op == "JOIN" for x in actions) and R.static_names(atoms) and local.possible(pattern)


def records_of_a_row(layouts: list[list[tuple[int, int, int]]] | None, pattern: S.Table) -> int | None:
    """How many records each row of a pattern within rows makes, if that is the same for all and known from the pattern; else None."""
    leaves = Atoms(pattern).leaves
    if layouts is None or not all(isinstance(leaf, S.Atom) for leaf in leaves):
        return None
    counts = {sum(R.first_record(leaves[leaf]) is not None for _, leaf, _ in cells if leaf >= 0) for cells in layouts}
    return counts.pop() if len(counts) == 1 else None


def extract_rows(
    rows: DataFrame, pattern: S.Table | str, schema: list[str], bindings: Bindings | None = None, options: R.Options | None = None,
    table_id: str = "table_id", part: str | None = None, row: str = "row", cells: str = "cells", keep: bool = True, widths: dict[str, int] | None = None,
) -> DataFrame:
    """The records of tables given row by row: what `extract` gives for the same tables as grids.

    rows: the table's id, a number that orders its rows (within `part`, if there is one), and
    the cells, array<string>.  Rows of one id, null too, are one table.  Null cells count as
    empty.  Tables with rows of different lengths don't match.
    """
    options = options or R.Options()
    pattern = compile_pattern(pattern, bindings) if isinstance(pattern, str) else pattern
    automaton = Automaton(Shape(pattern))
    # A struct is never null, so that rows without an id meet in joins, too.
    named = rows.select(F.struct(F.col(f"`{table_id}`").alias("id")).alias("table_id"), (F.col(f"`{part}`") if part else F.lit(0)).cast("long").alias("part"), F.col(f"`{row}`").cast("long").alias("row"), F.col(f"`{cells}`").alias("cells"))
    placed = placed_rows(named, pattern)
    compound = any(isinstance(leaf, S.Compound) for leaf in automaton.shape.leaves)
    placed = placed.persist() if keep and compound else placed
    own = F.struct("unit", F.col("subtable").alias("nth"))
    layouts = layouts_of(automaton.shape)
    compounds = [(k, leaf) for k, leaf in enumerate(automaton.shape.leaves) if isinstance(leaf, S.Compound)]
    found = _laid_out(layouts) if layouts else F.filter(automaton.row_cells(F.col("text"), own, F.lit(0)), lambda c: c["leaf"] >= 0)
    matched = placed.withColumn("found", found)
    if compounds:
        # A text without one of its delimiters fails its whole table.
        text = lambda c: F.coalesce(F.get("cells", c["col"]), F.lit(""))
        wrong = F.lit(False)
        for k, leaf in compounds:
            wrong = wrong | F.exists("found", _lacks(k, leaf, text))
        failed = matched.where(wrong).select("table_id").distinct()
        matched = matched.join(failed, "table_id", "left_anti")
    if within_rows(pattern, options):
        key = F.struct("table_id", "chunk", "number")
        members = local.records_of_items(arrays_of(matched.select(key.alias("table_id"), F.array("cells").alias("grid"), F.col("found").alias("cells")), pattern), pattern, options)
        each = members.select("table_id.*", F.col("rec_no").alias("n"), "members")
        per_row = records_of_a_row(layouts, pattern)
        if per_row is not None:
            # A row's number says how many records come before its own.
            made = each.select("table_id", (F.col("number") * per_row + F.col("n")).cast("int").alias("rec_no"), "members")
        else:
            each = each.persist() if keep else each
            sizes = each.groupBy("table_id", "chunk").count()
            before = Window.partitionBy("table_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
            offsets = sizes.select("table_id", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
            within = F.row_number().over(Window.partitionBy("table_id", "chunk").orderBy("number", "n")) - 1
            made = each.withColumn("within", within).join(offsets, ["table_id", "chunk"]).select("table_id", (F.col("before") + F.col("within")).cast("int").alias("rec_no"), "members")
        out = wide_members(R.checked(made, options), schema)
    else:
        if layouts:
            found_items = _items(matched, layouts, pattern)
        else:
            cell = matched.select("table_id", "number", "cells", F.explode("found").alias("c"))
            place = F.col("number") * F.size("cells") + F.col("c.col")
            found_items = items_of(cell.select("table_id", place.alias("place"), F.col("number").cast("int").alias("row"), "c.col", "c.leaf", "c.subtable", "c.subrow", F.coalesce(F.get("cells", F.col("c.col")), F.lit("")).alias("text")), pattern)
        out = R.wide_of_items(found_items, pattern, options, keep, schema)
        if out is None:
            made = R.checked(R.records_of_items(found_items, pattern, options, keep), options)
            out = wide_members(made, schema) if R.static_names(Atoms(pattern).atoms) else wide(R.fields(made, options), schema)
    return applied(R.named_again(out), pattern.settings, widths=widths)


def _lacks(k: int, leaf: S.Compound, text):
    return lambda c: (c["leaf"] == k) & ~segments(text(c), leaf)["ok"]
