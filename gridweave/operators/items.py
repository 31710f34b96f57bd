"""Items: what the matched cells' texts give."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.functions import text as T
from gridweave.operators.match import Shape, cell_text, is_formatted, match, segments
from gridweave.plans import spec as S

#: Room for the items of one cell in an item's sequence number.
STRIDE = 1 << 20


class Atoms:
    """The atoms of a pattern's leaves, numbered."""

    def __init__(self, pattern: S.Table):
        self.leaves = Shape(pattern).leaves
        self.atoms: list[S.Atom] = []
        self.number: dict[tuple[int, int], int] = {}
        for k, leaf in enumerate(self.leaves):
            for i, atom in enumerate(S.atoms_of(leaf)):
                self.number[k, i] = len(self.atoms)
                self.atoms.append(atom)


def kind_and_tags(atoms: Atoms, number: Column) -> tuple[Column, Column]:
    """An atom's kind and tags by its number."""
    kinds = F.array(*(F.lit(a.kind) for a in atoms.atoms))
    tags = F.array(*(F.array(*map(F.lit, a.tags)).cast("array<string>") for a in atoms.atoms))
    return F.get(kinds, number), F.get(tags, number)


def _item(text: Column, atom: S.Atom, number: int, index: Column, start: Column | None, end: Column | None) -> Column:
    if start is None or end is None:
        return F.struct(F.lit(number).alias("atom"), index.cast("int").alias("idx"), T.extracted(text, atom.extract).alias("s"))
    return F.struct(F.lit(number).alias("atom"), index.cast("int").alias("idx"), T.extracted(text, atom.extract).alias("s"), start.cast("int").alias("start"), end.cast("int").alias("end"))


def _parts(text: Column, content: S.Delimited, number: int, offset: Column | None) -> Column:
    """The parts of a delimited text that aren't blank, each with its place in the list, and in the text if the text's offset is given."""
    width = len(content.by)
    if offset is None:
        placed = F.transform(T.split(text, content.by), lambda p, i: F.struct(p.alias("text"), i.alias("i")))
        kept = F.filter(placed, lambda x: ~T.is_blank(T.trimmed(x["text"])))
        return F.transform(kept, lambda x: _item(T.trimmed(x["text"]), content.atom, number, x["i"], None, None))

    start = F.struct(offset.cast("int").alias("at"), F.array().cast("array<int>").alias("starts"))
    step = lambda a, p: F.struct((a["at"] + F.length(p) + width).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts"))

    def parts(split: Column) -> Column:
        starts = F.aggregate(split, start, step, lambda a: a["starts"])
        one = lambda p, i: F.struct(p.alias("text"), i.alias("i"), F.get(starts, i).alias("start"))
        kept = F.filter(F.transform(split, one), lambda x: ~T.is_blank(T.trimmed(x["text"])))
        return F.transform(kept, lambda x: _item(T.trimmed(x["text"]), content.atom, number, x["i"], x["start"], x["start"] + F.length(x["text"])))

    # A one-element array binds the parts, so that the text is split once.
    return F.element_at(F.transform(F.array(T.split(text, content.by)), parts), 1)


def leaf_items(text: Column, k: int, leaf: S.Content, atoms: Atoms, spans: bool) -> Column:
    zero = F.lit(0)
    match leaf:
        case S.Atom():
            return F.array(_item(text, leaf, atoms.number[k, 0], zero, zero if spans else None, F.length(text)))
        case S.Delimited():
            return _parts(text, leaf, atoms.number[k, 0], zero if spans else None)
    places = segments(text, leaf)["places"]
    out = []
    for i, (_, segment) in enumerate(leaf.segments):
        place = F.get(places, F.lit(i))
        part = F.substring(text, place["from"] + 1, place["to"] - place["from"])
        if isinstance(segment, S.Delimited):
            out.append(_parts(part, segment, atoms.number[k, i], place["from"] if spans else None))
        else:
            out.append(F.array(_item(part, segment, atoms.number[k, i], zero, place["from"] if spans else None, place["to"])))
    # Every segment, and every part of a delimited one, takes the next index; skipped ones too.
    numbered = F.transform(F.concat(*out), lambda x, i: x.withField("idx", i.cast("int")))
    skipped = [atoms.number[k, i] for i, (_, s) in enumerate(leaf.segments) if isinstance(s, S.Atom) and s.kind == S.SKIP]
    return F.filter(numbered, lambda x: ~x["atom"].isin(skipped)) if skipped else numbered


def item_arrays(tables: DataFrame, pattern: S.Table, table_id: str = "table_id", grid: str = "grid") -> DataFrame:
    """(table_id, items): what items() gives for each table, as an array in the same order, without places in the text; null for tables that don't match."""
    return arrays_of(match(named_tables(tables, table_id, grid), pattern), pattern)


def named_tables(tables: DataFrame, table_id: str, grid: str) -> DataFrame:
    return tables.select(F.col(f"`{table_id}`").alias("table_id"), F.col(f"`{grid}`").alias("grid"))


def arrays_of(placed: DataFrame, pattern: S.Table) -> DataFrame:
    """item_arrays for matched tables (table_id, grid, cells)."""
    atoms = Atoms(pattern)
    text_of = cell_text(is_formatted(placed, "grid"))

    text_at = lambda cell: F.coalesce(text_of(F.get(F.get("grid", cell["row"]), cell["col"])), F.lit(""))
    places = ("row", "col", "subtable", "subrow")

    def of_atom(cell: Column, place: Column) -> Column:
        """The item of a cell, if no cell has more than one."""
        number = F.get(F.array(*(F.lit(atoms.number[k, 0]) for k in range(len(atoms.leaves)))), cell["leaf"])
        given = [(k, T.extracted(text_at(cell), leaf.extract)) for k, leaf in enumerate(atoms.leaves)]
        alike = all(leaf.extract == atoms.leaves[0].extract for leaf in atoms.leaves)
        s = given[0][1] if alike else reduce(lambda a, kv: a.when(cell["leaf"] == kv[0], kv[1]), given[1:], F.when(cell["leaf"] == given[0][0], given[0][1]))
        kind, tags = kind_and_tags(atoms, number)
        own = [(place.cast("long") * STRIDE).alias("seq"), number.alias("atom"), F.lit(0).alias("idx"), s.alias("s"), kind.alias("kind"), tags.alias("tags")]
        return F.struct(*own, *(cell[c].alias(c) for c in places))

    def of_cell(cell: Column, place: Column) -> Column:
        def of_text(text: Column) -> Column:
            given = [(k, leaf_items(text, k, leaf, atoms, False)) for k, leaf in enumerate(atoms.leaves)]
            return reduce(lambda a, kv: a.when(cell["leaf"] == kv[0], kv[1]), given[1:], F.when(cell["leaf"] == given[0][0], given[0][1]))

        def item(i: Column, n: Column) -> Column:
            number = place.cast("long") * STRIDE + n
            kind, tags = kind_and_tags(atoms, i["atom"])
            own = [number.alias("seq"), *(i[c].alias(c) for c in ("atom", "idx", "s")), kind.alias("kind"), tags.alias("tags")]
            return F.struct(*own, *(cell[c].alias(c) for c in places))

        return F.transform(F.element_at(F.transform(F.array(text_at(cell)), of_text), 1), item)

    nothing = F.array().cast("array<struct<seq:bigint,atom:int,idx:int,s:string,kind:string,tags:array<string>,row:int,col:int,subtable:int,subrow:int>>")
    if atoms.leaves and all(isinstance(leaf, S.Atom) for leaf in atoms.leaves):
        return placed.select("table_id", F.transform("cells", of_atom).alias("items"))
    return placed.select("table_id", (F.flatten(F.transform("cells", of_cell)) if atoms.leaves else nothing).alias("items"))


def items(tables: DataFrame, pattern: S.Table, table_id: str = "table_id", grid: str = "grid", spans: bool = True) -> DataFrame:
    """(table_id, seq, atom, idx, s, kind, tags, row, col, subtable, subrow, start, end) for every item of the matching tables.

    seq orders a table's items as the pattern meets them; start and end, if spans are asked
    for, are the code points of the text that the item was extracted from.
    """
    # An outer one, so that no filter on the cells is derived, for which they would be matched twice.
    placed = match(named_tables(tables, table_id, grid), pattern).select("table_id", "grid", F.posexplode_outer("cells").alias("place", "cell")).where("cell is not null")
    text_of = cell_text(is_formatted(placed, "grid"))
    text = F.coalesce(text_of(F.get(F.get("grid", F.col("cell.row")), F.col("cell.col"))), F.lit(""))
    return items_of(placed.select("table_id", "place", "cell.*", text.alias("text")), pattern, spans)


def items_of(cells: DataFrame, pattern: S.Table, spans: bool = False) -> DataFrame:
    """The items of cells (table_id, place, row, col, leaf, subtable, subrow, text); place orders a table's cells."""
    atoms = Atoms(pattern)
    given = [(k, leaf_items(F.col("text"), k, leaf, atoms, spans)) for k, leaf in enumerate(atoms.leaves)]
    made = reduce(lambda a, kv: a.when(F.col("leaf") == kv[0], kv[1]), given[1:], F.when(F.col("leaf") == given[0][0], given[0][1])) if given else F.array()
    out = cells.select("table_id", "place", "row", "col", "subtable", "subrow", F.posexplode(made).alias("n", "item"))
    kind, tags = kind_and_tags(atoms, F.col("item.atom"))
    return out.select(
        "table_id", (F.col("place").cast("long") * STRIDE + F.col("n")).alias("seq"), "item.atom", "item.idx", "item.s",
        kind.alias("kind"), tags.alias("tags"), "row", "col", "subtable", "subrow", *(("item.start", "item.end") if spans else ()),
    )


def most_cells(pattern: S.Table) -> int | None:
    """How many cells a table that matches has at most; None if the pattern sets no bound."""

    def most(elements, of) -> int | None:
        each = [(e.times.high, of(e)) for e in elements]
        return None if any(n is None or m is None for n, m in each) else sum(n * m for n, m in each)

    # Two rows may be of different elements, but all are of one length: the sum is no less.
    return most(pattern.subtables, lambda t: most(t.rows, lambda r: most(r.subrows, lambda s: most(s.cells, lambda c: 1))))


def most_items(pattern: S.Table, grid: Column, text_of) -> Column | None:
    """How many items the delimited cells of a grid have at most; None if the pattern has no such cells."""
    contents = [p for leaf in Shape(pattern).leaves for p in (leaf.segments if isinstance(leaf, S.Compound) else [(None, leaf)])]
    marks = sorted({c.by for _, c in contents if isinstance(c, S.Delimited) and c.by})
    if not marks:
        return None
    cells = F.transform(F.flatten(grid), lambda c: F.coalesce(text_of(c), F.lit("")))
    count = lambda c, by: ((F.length(c) - F.length(F.replace(c, F.lit(by), F.lit("")))) / len(by)).cast("long") + 1
    return F.aggregate(cells, F.lit(0).cast("long"), lambda n, c: n + F.greatest(*(count(c, m) for m in marks), F.lit(0).cast("long")))
