"""Tables of one layout: patterns without repetitions, choices or delimited cells, in which each cell's place is known before any table is read.

What lookups by place and tag find is then known as well, so a table's records are plain
expressions on its cells, without arrays of items that each lookup would look through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.functions import text as T
from gridweave.operators import records as R
from gridweave.operators.items import STRIDE, Atoms, most_cells
from gridweave.operators.lookups import _keys, _rest, uses, wanted_kind
from gridweave.operators.match import is_formatted, test_column
from gridweave.plans import spec as S

#: Items that all lookups of a layout find together, at most: a plan has an expression for each.
FOUND = 512


@dataclass(frozen=True)
class Item:
    """An item's place; its texts are the columns s, val and attr with its number."""

    number: int
    atom: int
    row: int
    col: int
    subtable: int
    subrow: int
    idx: int = 0

    @property
    def seq(self) -> int:
        return self.number * STRIDE


def _each(elements) -> Iterator[tuple[int, object]]:
    """The elements of a list as often as they are repeated, with their numbers."""
    return ((k, e) for k, e in enumerate(elements) for _ in range(e.times.low))


def _static(term: S.Term) -> bool:
    return isinstance(term, S.Spatial | S.Place) or isinstance(term, S.Test) and term.kind == "tag"


class Layout:
    """The places of a pattern's cells and items, and what its lookups find; `of` gives none for patterns that have no layout."""

    def __init__(self, pattern: S.Table):
        self.atoms = Atoms(pattern).atoms
        self.items: list[Item] = []
        self.guards: list[tuple[S.Test, list[tuple[int, int]]]] = []
        self.widths: list[int] = []
        with_item = lambda c: c.content is not None and c.content.kind != S.SKIP
        places = ((t, r, s, c) for t, x in enumerate(pattern.subtables) for r, y in enumerate(x.rows) for s, z in enumerate(y.subrows) for c, cell in enumerate(z.cells) if with_item(cell))
        number = {place: n for n, place in enumerate(places)}
        for nth_table, (t, subtable) in enumerate(_each(pattern.subtables)):
            top = len(self.widths)
            for r, row in _each(subtable.rows):
                at, col = len(self.widths), 0
                for nth_subrow, (s, subrow) in enumerate(_each(row.subrows)):
                    left = col
                    for c, cell in _each(subrow.cells):
                        self._guard(cell.guard, [(at, col)])
                        if with_item(cell):
                            self.items.append(Item(len(self.items), number[t, r, s, c], at, col, nth_table, nth_subrow))
                        col += 1
                    self._guard(subrow.guard, [(at, c) for c in range(left, col)])
                self._guard(row.guard, [(at, c) for c in range(col)])
                self.widths.append(col)
            self._guard(subtable.guard, [(r, c) for r in range(top, len(self.widths)) for c in range(self.widths[r])])
        self._guard(pattern.guard, [(r, c) for r, n in enumerate(self.widths) for c in range(n)])
        ops = R._STRING_OPS, ("AVP",), ("REC",)
        self.lookups = {(n, act, prov): lookup for some in ops for (lookup, _), by_atom in uses(self.atoms, some).items() for n, at in by_atom.items() for act, prov in at}
        self.found = {(i.number, *at[1:]): self._found(i, at) for i in self.items for at in self.lookups if at[0] == i.atom}

    @classmethod
    def of(cls, pattern: S.Table) -> Layout | None:
        if (most_cells(pattern) or R.LOCAL_CELLS + 1) > R.LOCAL_CELLS:
            return None
        rows = [r for t in pattern.subtables for r in t.rows]
        subrows = [s for r in rows for s in r.subrows]
        cells = [c for s in subrows for c in s.cells]
        elements = [*pattern.subtables, *rows, *subrows, *cells]
        if any(e.times.low != e.times.high or not e.times.low for e in elements) or not all(isinstance(c.content, S.Atom | None) for c in cells):
            return None
        guards = [e.guard for e in (pattern, *elements) if e.guard is not None]
        if any(g.kind == "ext" and (not g.columnar or isinstance(g.call, S.Whole)) for g in guards):
            return None
        atoms = Atoms(pattern).atoms
        actions = [x for a in atoms for x in a.actions]
        terms = [t for x in actions for p in x.providers if isinstance(p, S.Lookup) for branch in p.condition for t in branch]
        if any(x.op == "JOIN" for x in actions) or not all(map(_static, terms)) or any(step[0] == "CALL" and not step[2] for a in atoms for step in a.extract):
            return None
        layout = cls(pattern)
        known = layout.items and len(set(layout.widths)) == 1 and sum(map(len, layout.found.values())) <= FOUND
        return layout if known else None

    def _guard(self, guard: S.Test | None, places: list[tuple[int, int]]) -> None:
        if guard is not None:
            self.guards.append((guard, places))

    def _found(self, anchor: Item, at: tuple[int, int, int]) -> list[Item]:
        """What a provider finds for an item, in order."""
        lookup = self.lookups[at]
        wanted = wanted_kind(lookup, self.atoms[anchor.atom].actions[at[1]].op)
        sign = -1 if lookup.order.startswith("-") else 1
        places = ("col", "row") if lookup.order.endswith("^") else ("row", "col")

        def meets(term: S.Term, c: Item) -> bool:
            if isinstance(term, S.Test):
                return (term.arg in self.atoms[c.atom].tags) != term.negated
            equal = all(getattr(c, own) == getattr(anchor, other) + offset for other, own, offset in _keys(term))
            rest = _rest(term, lambda n: getattr(anchor, n), lambda n: getattr(c, n))  # on numbers, as on Columns
            return equal and rest is not False

        fits = [c for c in self.items if c != anchor and (wanted is None or self.atoms[c.atom].kind == wanted) and any(all(meets(t, c) for t in branch) for branch in lookup.condition)]
        return sorted(fits, key=lambda c: (*(getattr(c, p) * sign for p in places), c.idx, c.seq))[: lookup.most]

    def name_of(self, item: Item) -> tuple[bool, str | None]:
        """Whether the pattern alone tells an item's attribute, and which."""
        atom = self.atoms[item.atom]
        for act, action in enumerate(atom.actions if atom.kind == S.VAL else ()):
            if action.op == "AVP":
                if isinstance(action.providers[0], S.Literal):
                    return True, action.providers[0].text
                if self.found[item.number, act, 0]:
                    return False, None
        return True, None

    def anchors(self, options: R.Options) -> list[Item]:
        """The items that make records, in order."""
        places = ("row", "col") if options.actions_by == "row" else ("col", "row")
        return sorted((i for i in self.items if R.first_record(self.atoms[i.atom]) is not None), key=lambda i: (*(getattr(i, p) for p in places), i.seq))

    def members(self, anchor: Item) -> list[Item | S.Literal | S.Pair]:
        """The members of an anchor's record, itself first."""
        atom = self.atoms[anchor.atom]
        act = R.first_record(atom)
        given = ([p] if isinstance(p, S.Literal | S.Pair) else self.found[anchor.number, act, prov] for prov, p in enumerate(atom.actions[act].providers))
        return [anchor, *chain.from_iterable(given)]

    def names(self, anchor: Item) -> list[str] | None:
        """The attributes that a record's members have; None if the pattern alone doesn't tell, or one has an attribute twice."""
        known = [(True, getattr(m, "attr", None)) if not isinstance(m, Item) else self.name_of(m) for m in self.members(anchor)]
        names = [name for _, name in known if name is not None]
        return names if all(k for k, _ in known) and len(set(names)) == len(names) else None

    def matched(self, tables: DataFrame) -> DataFrame:
        """The tables (table_id, grid) that match, as table_id and each item's final text and attribute (val0, attr0, ...)."""
        grid = F.col("grid")
        text = lambda r, c: F.coalesce(F.get(F.get(grid, F.lit(r)), F.lit(c)), F.lit(""))
        sizes = [F.size(grid) == len(self.widths), *(F.size(F.get(grid, F.lit(r))) == n for r, n in enumerate(self.widths))]
        held = [F.coalesce(test_column(test, text(*place)), F.lit(test.negated)) for test, places in self.guards for place in places]
        matching = tables.where(reduce(Column.__and__, [*sizes, *held]))
        first = matching.select("table_id", *(T.extracted(text(i.row, i.col), self.atoms[i.atom].extract).alias(f"s{i.number}") for i in self.items))

        def value(item: Item) -> Column:
            own = lambda n: F.col(f"{n}{item.number}")
            found = lambda atom, act, prov: F.array(*(F.col(f"s{i.number}") for i in self.found.get((item.number, act, prov), []))).cast("array<string>")
            made = R.value_of(self.atoms[item.atom], own, found)
            return own("s") if made is None else made

        def attribute(item: Item) -> Column:
            found = lambda atom, act, prov: F.array(*(F.struct(F.col(f"val{i.number}").alias("val")) for i in self.found.get((item.number, act, prov), []))).cast("array<struct<val:string>>")
            made = R.attribute_of(self.atoms[item.atom], found)
            return F.lit(None).cast("string") if made is None else made

        second = first.select("table_id", *(value(i).alias(f"val{i.number}") for i in self.items))
        return second.select("*", *(attribute(i).alias(f"attr{i.number}") for i in self.items))


def layout_of(tables: DataFrame, pattern: S.Table) -> Layout | None:
    """The layout of a pattern for these tables; None if it has none, or for cells that are more than a text."""
    return None if is_formatted(tables, "grid") else Layout.of(pattern)


def arrays_of_records(tables: DataFrame, layout: Layout, options: R.Options) -> DataFrame:
    """(table_id, records) of the tables that match: an array of structs with the members."""
    literals = R.literals_of(layout.atoms)

    def member(m: Item | S.Literal | S.Pair) -> Column:
        match m:
            case S.Literal(text):
                own = F.lit(-1 - literals[text]), F.lit(None), F.lit(text)
            case S.Pair(attr, value):
                own = F.lit(None), F.lit(attr), F.lit(value)
            case _:
                own = F.lit(m.seq), F.col(f"attr{m.number}"), F.col(f"val{m.number}")
        return F.struct(*(c.cast(kind).alias(n) for n, kind, c in zip(("seq", "attr", "val"), ("long", "string", "string"), own, strict=True)))

    each = [F.struct(F.array(*map(member, layout.members(a))).cast(R.MEMBERS).alias("members")) for a in layout.anchors(options)]
    return layout.matched(tables).select("table_id", F.array(*each).cast(f"array<struct<members:{R.MEMBERS}>>").alias("records"))


def wide(tables: DataFrame, layout: Layout, options: R.Options, schema: list[str]) -> DataFrame | None:
    """(table_id, rec_no) and a column for each attribute of the schema; None if the pattern alone doesn't tell each record's attributes."""
    anchors = layout.anchors(options)
    if not anchors or not R.static_names(layout.atoms) or any(layout.names(a) is None for a in anchors):
        return None

    def record(n: int, anchor: Item) -> list[Column]:
        of_item = lambda m: (layout.name_of(m)[1], F.col(f"val{m.number}")) if isinstance(m, Item) else (getattr(m, "attr", None), F.lit(getattr(m, "value", None)))
        values = dict(map(of_item, layout.members(anchor)))
        return [F.lit(n).alias("rec_no"), *((values[a] if a in values else F.lit(None)).cast("string").alias(f"c{i}") for i, a in enumerate(schema))]

    found = layout.matched(tables)
    if len(anchors) == 1:
        out = found.select("table_id", *record(0, anchors[0]))
    else:
        out = found.select("table_id", F.inline(F.array(*(F.struct(*record(n, a)) for n, a in enumerate(anchors)))))
    return out.toDF("table_id", "rec_no", *schema)
