"""Providers: for each item with actions, the items its lookups find.

Every lookup stays within a table.  In tables of up to some cells it is an expression on the
array of the table's items (module `local`).  In larger ones most lookups look along a line
of items: a row, a column, a subtable, a cell, the whole table, or the items of one string
in these; what else they ask of an item its own string, tags and place tell.  Of such

- one item to one side is a running minimum or maximum along the line (`nearest`);
- the first item in any other cell is the line's first one, or for that one's cell the first
  behind it: two minima of the line, in no order (`firsts_elsewhere`);
- a few items are bounded lists carried along the line: the first so many of it that lie
  before an item, and the next so many behind it (`few`);
- all items, or many, are a list for each line, collected once and shared by its items,
  each of which takes its part (`shared_lines`).

No pairs of items are made for these.  Others (alternatives, offsets, tests of two items)
are self-joins: terms on rows, columns, subrows, subtables, offsets and equal strings become
equi-join keys when all branches of the condition share them; the rest is the join's
condition, and limits are ranks in the lookup's order.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.operators.match import test_column
from gridweave.plans import spec as S

#: What an anchor's columns are called in a join.
ANCHOR = "a_"
_STRING_OPS = ("FILL", "PREFIX", "SUFFIX")


def _keys(term: S.Term) -> set[tuple[str, str, int]]:
    """Equalities (anchor column, candidate column, offset) that a term implies."""
    same = lambda *names: {(n, n, 0) for n in names}
    match term:
        case S.Spatial("LT" | "RT" | "SR"):
            return same("row", "subrow")
        case S.Spatial("AV" | "BW" | "SC"):
            return same("subtable", "col")
        case S.Spatial("ST"):
            return same("subtable")
        case S.Spatial("ROW"):
            return same("row")
        case S.Spatial("COL"):
            return same("col")
        case S.Spatial("CL"):
            return same("row", "col")
        case S.SameText():
            return same("s")
        case S.Place("C", n, None, True):
            return {("col", "col", n)}
        case S.Place("R", n, None, True):
            return {("row", "row", n)}
        case S.Place("P", n, None, True):
            return {("idx", "idx", n)}
    return set()


def _rest(term: S.Term, a, c) -> Column | None:
    """What a term asks besides its equalities; a and c give an anchor's and a candidate's columns."""
    other_cell = (a("row") != c("row")) | (a("col") != c("col"))
    match term:
        case S.Spatial("LT"):
            return c("col") < a("col")
        case S.Spatial("RT"):
            return c("col") > a("col")
        case S.Spatial("AV"):
            return c("row") < a("row")
        case S.Spatial("BW"):
            return c("row") > a("row")
        case S.Spatial("SR" | "ROW"):
            return c("col") != a("col")
        case S.Spatial("SC" | "COL"):
            return c("row") != a("row")
        case S.Spatial("ST" | "NCL"):
            return other_cell
        case S.Place(axis, low, high, relative):
            column = {"C": "col", "R": "row", "P": "idx"}[axis]
            at = c(column) - a(column) if relative else c(column)
            if high is None:
                return None if relative else at == low
            return (at >= low) & (at <= high) if high != S.NO_END else at >= low
        case S.Test("tag", name, negated):
            found = F.array_contains(c("tags"), name)
            return ~found if negated else found
        case S.Test("ext") if not term.columnar:
            return F.udf(lambda s: bool(term.call(s)) != term.negated, "boolean", useArrow=True)(c("s"))
        case S.Test():
            return test_column(term, c("s"))
        case S.PairTest(_, call, True):
            return call(a, c)
        case S.PairTest(_, call, False):
            item = lambda x: F.struct(*(x(n).alias(n) for n in ("s", "row", "col", "idx", "subtable", "subrow", "kind", "tags")))
            return F.udf(lambda x, y: bool(call(x, y)), "boolean", useArrow=True)(item(a), item(c))
    return None


def condition_of(condition: S.Condition, a, c) -> Column:
    """Whether a candidate meets the condition for an anchor of its table, with the equalities that all branches share in front."""
    keys = [set().union(*map(_keys, branch)) for branch in condition]
    shared = set.intersection(*keys)
    equal = lambda k: c(k[1]) == (a(k[0]) + k[2] if k[2] else a(k[0]))

    def branch(terms, own) -> Column:
        parts = [equal(k) for k in sorted(own - shared)] + [r for t in terms if (r := _rest(t, a, c)) is not None]
        return reduce(Column.__and__, parts) if parts else F.lit(True)

    either = reduce(Column.__or__, [branch(t, k) for t, k in zip(condition, keys, strict=True)])
    return reduce(Column.__and__, [*map(equal, sorted(shared)), c("seq") != a("seq"), either])


def common_columns(lookup: S.Lookup) -> set[str]:
    """The columns in which an item and all that the lookup finds for it are equal."""
    branches = [set().union(*map(_keys, branch)) for branch in lookup.condition]
    return {own for own, other, offset in set.intersection(*branches) if own == other and not offset} if branches else set()


def join_condition(condition: S.Condition) -> Column:
    """The condition of the self-join."""
    a, c = (lambda n: F.col(ANCHOR + n)), (lambda n: F.col(n))
    return (F.col("table_id") == F.col(ANCHOR + "table_id")) & condition_of(condition, a, c)


def _order(lookup: S.Lookup) -> list[Column]:
    """Two numbers that order the candidates' cells; within a cell the index ascends."""
    sign = -1 if lookup.order.startswith("-") else 1
    cells = ("col", "row") if lookup.order.endswith("^") else ("row", "col")
    return [(F.col(c) * sign).alias(f"o{i}") for i, c in enumerate(cells, 1)]


#: Terms that leave one line of cells to one side of the anchor: what is equal on it, what grows along it, whether it lies before.
_SIDES = {"LT": (("row", "subrow"), "col", True), "RT": (("row", "subrow"), "col", False), "AV": (("subtable", "col"), "row", True), "BW": (("subtable", "col"), "row", False)}


def one_on_a_line(lookup: S.Lookup) -> tuple[S.Spatial, list[S.Test]] | None:
    """The term and the tests of a lookup that asks for one item on a line and of it only what its own string and tags tell."""
    if lookup.most != 1 or len(lookup.condition) != 1:
        return None
    sides = [t for t in lookup.condition[0] if isinstance(t, S.Spatial)]
    tests = [t for t in lookup.condition[0] if isinstance(t, S.Test)]
    if len(sides) != 1 or sides[0].name not in _SIDES or len(sides) + len(tests) < len(lookup.condition[0]):
        return None
    return sides[0], tests


def nearest(items: DataFrame, lookup: S.Lookup, wanted: str | None, carry: tuple[str, ...]) -> DataFrame:
    """The items with `best`: what such a lookup finds, by a running extremum along each line instead of pairs."""
    side, tests = one_on_a_line(lookup)
    same, along, before = _SIDES[side.name]
    fits = [r for t in tests if (r := _rest(t, F.col, F.col)) is not None] + ([F.col("kind") == wanted] if wanted else [])
    # In a cell the first item counts, whichever way the line is read.
    last = lookup.order.startswith("-")
    sign = -1 if last else 1
    place = [F.col(along).alias("along"), (F.col("idx") * sign).alias("idx"), (F.col("seq") * sign).alias("seq"), F.struct(*carry).alias("found")]
    own = F.when(reduce(Column.__and__, fits, F.lit(True)), F.struct(*place))
    line = Window.partitionBy("table_id", *same).orderBy(F.col(along) if before else F.desc(along)).rangeBetween(Window.unboundedPreceding, -1)
    return items.withColumn("best", (F.max if last else F.min)(own).over(line))


def kinds_for(op: str) -> tuple[tuple[str, ...], str | None]:
    """Kinds that may be anchors of an action, and the kind its candidates must have."""
    if op in _STRING_OPS:
        return (S.VAL, S.ATTR), None
    return (S.VAL,), S.ATTR if op == "AVP" else S.VAL


def wanted_kind(lookup: S.Lookup, op: str) -> str | None:
    """The kind of the items a lookup of an action may find; None for any."""
    if lookup.kind is None:
        return kinds_for(op)[1]
    return None if lookup.kind == S.ANY_KIND else lookup.kind


def uses(atoms: list[S.Atom], ops: tuple[str, ...]) -> dict[tuple[S.Lookup, str | None], dict[int, list[tuple[int, int]]]]:
    """Each lookup and candidate kind of these operations -> for each atom using it, the action and provider numbers.

    An action that its atom's kind doesn't allow is left out if it was inherited; else it is an error.
    """
    out: dict[tuple[S.Lookup, str | None], dict[int, list[tuple[int, int]]]] = {}
    for n, atom in enumerate(atoms):
        for act, action in enumerate(atom.actions):
            anchors, _ = kinds_for(action.op)
            if action.op not in ops:
                continue
            if atom.kind == S.SKIP or atom.kind not in anchors and action.inherited:
                continue
            if atom.kind not in anchors:
                if action.op in _STRING_OPS or any(isinstance(p, S.Lookup) for p in action.providers):
                    raise S.PatternError(f"{action.op} isn't for {atom.kind} items")
                continue
            for prov, provider in enumerate(action.providers):
                if isinstance(provider, S.Lookup):
                    out.setdefault((provider, wanted_kind(provider, action.op)), {}).setdefault(n, []).append((act, prov))
    return out


@dataclass(frozen=True)
class Scope:
    """A line of items that a lookup looks along, and what it asks of an item on it.

    same: columns that an anchor and its candidates have in common.  before, after: whether
    candidates may lie before and after the anchor in table order; by_item: by their place
    in the order of items, else in another cell.
    """

    same: tuple[str, ...]
    before: bool
    after: bool
    by_item: bool
    tests: tuple[S.Term, ...]


_LINES = {
    "LT": (("row", "subrow"), True, False), "RT": (("row", "subrow"), False, True), "SR": (("row", "subrow"), True, True),
    "AV": (("subtable", "col"), True, False), "BW": (("subtable", "col"), False, True), "SC": (("subtable", "col"), True, True),
    "ROW": (("row",), True, True), "COL": (("col",), True, True), "ST": (("subtable",), True, True), "NCL": ((), True, True),
}


def scope_of(lookup: S.Lookup) -> Scope | None:
    """The line a lookup looks along; None if it can't be said of a candidate alone whether it is on it and fits."""
    if len(lookup.condition) != 1:
        return None
    terms = lookup.condition[0]
    lines = [t.name for t in terms if isinstance(t, S.Spatial)]
    tests = tuple(t for t in terms if isinstance(t, S.Test) or isinstance(t, S.Place) and not t.relative)
    strings = any(isinstance(t, S.SameText) for t in terms)
    if len(lines) > 1 or len(lines) + len(tests) + sum(isinstance(t, S.SameText) for t in terms) < len(terms):
        return None
    line = lines[0] if lines else None
    own = ("s",) if strings else ()
    if line in (None, "CL"):
        return Scope((("row", "col") if line else ()) + own, True, True, True, tests)
    same, before, after = _LINES[line]
    return Scope(same + own, before, after, False, tests)


#: Up to this many items a lookup's finds are carried along the line.
FEW = 64


def _fits(scope: Scope, wanted: str | None) -> Column:
    """Whether an item can be found at all, wherever the anchor is."""
    asked = [r for t in scope.tests if (r := _rest(t, F.col, F.col)) is not None] + ([F.col("kind") == wanted] if wanted else [])
    return F.coalesce(reduce(Column.__and__, asked, F.lit(True)), F.lit(False))


def _cell_number(lookup: S.Lookup) -> Column:
    """The place of an item's cell in the lookup's order."""
    first, second = ("col", "row") if lookup.order.endswith("^") else ("row", "col")
    number = F.col(first).cast("long") * (1 << 32) + F.col(second)
    return -number if lookup.order.startswith("-") else number


def _sides(lookup: S.Lookup, scope: Scope) -> tuple[bool, bool]:
    """Whether candidates may come earlier and later than the anchor in the lookup's order."""
    return (scope.after, scope.before) if lookup.order.startswith("-") else (scope.before, scope.after)


def _entry(carry: tuple[str, ...]) -> Column:
    return F.struct("cell_no", "idx", "seq", F.struct(*carry).alias("found"))


def few(items: DataFrame, lookup: S.Lookup, scope: Scope, wanted: str | None, carry: tuple[str, ...], name: str) -> DataFrame:
    """The items with what a lookup of up to FEW items finds, by lists of that length carried along each line."""
    line = ["table_id", *scope.same]
    order = [F.col("cell_no"), F.col("idx"), F.col("seq")]
    back = [c.desc() for c in order]
    out = items.withColumn("cell_no", _cell_number(lookup)).withColumn("fits", _fits(scope, wanted))
    by_item = scope.by_item
    whole = lambda w, o: w.orderBy(*o).rowsBetween(Window.unboundedPreceding, -1) if by_item else w.orderBy(o[0]).rangeBetween(Window.unboundedPreceding, -1)
    fitting = Window.partitionBy(*line, "fits").orderBy(*order)
    earlier, later = _sides(lookup, scope)
    parts = []
    if earlier:
        # The line's first fitting items, of which those before the anchor count.
        out = out.withColumn("head", F.when(F.col("fits") & (F.row_number().over(fitting) <= lookup.most), _entry(carry)))
        parts.append(F.array_sort(F.collect_list("head").over(whole(Window.partitionBy(*line), order))))
    if later:
        # Each fitting item with the next ones; the first one behind the anchor has them all.
        following = F.collect_list(_entry(carry)).over(fitting.rowsBetween(0, lookup.most - 1))
        out = out.withColumn("tail", F.when(F.col("fits"), F.struct("cell_no", "idx", "seq", following.alias("next"))))
        parts.append(F.coalesce(F.min("tail").over(whole(Window.partitionBy(*line), back))["next"], F.array().cast(_entries_type(items, carry))))
    found = F.slice(F.concat(*parts), 1, lookup.most)
    return out.withColumn(name, F.transform(found, lambda e: e["found"])).drop("cell_no", "fits", "head", "tail")


def _entries_type(items: DataFrame, carry: tuple[str, ...]) -> str:
    kinds = ",".join(f"{c}:{items.schema[c].dataType.simpleString()}" for c in carry)
    return f"array<struct<cell_no:bigint,idx:int,seq:bigint,found:struct<{kinds}>>>"


def shared_lines(items: DataFrame, lookup: S.Lookup, scope: Scope, wanted: str | None, carry: tuple[str, ...], name: str, atoms: list[int]) -> DataFrame:
    """The items with what an unlimited lookup finds: a list for each line, collected once; each anchor takes its part."""
    line = ["table_id", *scope.same]
    placed = items.withColumn("cell_no", _cell_number(lookup))
    lists = placed.where(_fits(scope, wanted)).groupBy(*(F.col(c).alias(f"line_{c}") for c in line)).agg(F.array_sort(F.collect_list(_entry(carry))).alias("line"))
    on = reduce(Column.__and__, [F.col(c) == F.col(f"line_{c}") for c in line])
    met = placed.join(lists, on & F.col("atom").isin(atoms), "left")
    if scope.by_item:
        own = F.filter("line", lambda e: e["seq"] != F.col("seq"))
    else:
        earlier, later = _sides(lookup, scope)
        here = F.col("cell_no")
        own = F.filter("line", lambda e: (e["cell_no"] != here) if earlier and later else (e["cell_no"] < here) if earlier else (e["cell_no"] > here))
    found = F.transform(own if lookup.most is None else F.slice(own, 1, lookup.most), lambda e: e["found"])
    return met.withColumn(name, found).drop("cell_no", "line", *(f"line_{c}" for c in line))


def paired(items: DataFrame, lookup: S.Lookup, wanted: str | None, carry: tuple[str, ...], name: str, atoms: list[int]) -> DataFrame:
    """The items with what any lookup finds, by a self-join."""
    anchors = items.where(F.col("atom").isin(atoms))
    anchors = anchors.select(*(F.col(c).alias(ANCHOR + c) for c in ("table_id", "seq", "row", "col", "subtable", "subrow", "idx", "s", "kind", "tags")))
    candidates = items if wanted is None else items.where(F.col("kind") == wanted)
    pairs = candidates.join(anchors, join_condition(lookup.condition)).select(
        F.col(ANCHOR + "table_id").alias("table_id"), F.col(ANCHOR + "seq").alias("anchor"), *_order(lookup), F.col("idx").alias("o3"), F.col("seq").alias("o4"), F.struct(*carry).alias("found")
    )
    if lookup.most is not None:
        order = Window.partitionBy("table_id", "anchor").orderBy("o1", "o2", "o3", "o4")
        pairs = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= lookup.most)
    entries = F.sort_array(F.collect_list(F.struct("o1", "o2", "o3", "o4", "found")))
    grouped = pairs.groupBy("table_id", F.col("anchor").alias("seq")).agg(F.transform(entries, lambda e: e["found"]).alias(name))
    return items.join(grouped, ["table_id", "seq"], "left")


def unordered(lookup: S.Lookup) -> bool:
    """Whether the lookup asks for the first item in any other cell of a line."""
    scope = scope_of(lookup)
    return scope is not None and lookup.most == 1 and not scope.by_item and scope.before and scope.after


def firsts_elsewhere(items: DataFrame, asked: list[tuple[S.Lookup, str | None, str]], carry: tuple[str, ...]) -> DataFrame:
    """The items with what such lookups (lookup, kind, name) find, those along one line together.

    The line's first cell finds the first one behind it, all others find the first cell's: no order is needed.
    """
    lines: dict[tuple[str, ...], list[tuple[S.Lookup, str | None, str]]] = {}
    for lookup, wanted, name in asked:
        lines.setdefault(scope_of(lookup).same, []).append((lookup, wanted, name))
    for same, own in lines.items():
        line = Window.partitionBy("table_id", *same)
        items = items.withColumns({f"own_{n}": F.when(_fits(scope_of(p), wanted), F.struct(_cell_number(p).alias("cell_no"), "idx", "seq", F.struct(*carry).alias("found"))) for p, wanted, n in own})
        items = items.withColumns({f"first_{n}": F.min(f"own_{n}").over(line) for *_, n in own})
        items = items.withColumns({f"second_{n}": F.min(F.when(F.col(f"own_{n}.cell_no") != F.col(f"first_{n}.cell_no"), F.col(f"own_{n}"))).over(line) for *_, n in own})
        best = lambda p, n: F.when(F.col(f"first_{n}.cell_no") == _cell_number(p), F.col(f"second_{n}")).otherwise(F.col(f"first_{n}"))
        items = items.withColumns({n: F.when(best(p, n).isNotNull(), F.array(best(p, n)["found"])) for p, _, n in own}).drop(*(f"{k}_{n}" for *_, n in own for k in ("own", "first", "second")))
    return items


def first_to_one_side(items: DataFrame, lookup: S.Lookup, scope: Scope, wanted: str | None, carry: tuple[str, ...], name: str) -> DataFrame:
    """The items with what a lookup of one item in another cell of the line, to one side of it, finds, as a running minimum."""
    out = items.withColumn("cell_no", _cell_number(lookup)).withColumn("own_entry", F.when(_fits(scope, wanted), _entry(carry)))
    # The next fitting item behind is the least of those met from the line's end.
    order = F.col("cell_no") if _sides(lookup, scope)[0] else F.col("cell_no").desc()
    line = Window.partitionBy("table_id", *scope.same).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("best", F.min("own_entry").over(line))
    return out.withColumn(name, F.when(F.col("best").isNotNull(), F.array(F.col("best.found")))).drop("cell_no", "own_entry", "best")


def _by_line(lookup: S.Lookup) -> Scope | None:
    """The scope of a lookup whose finds are carried along a line."""
    scope = scope_of(lookup)
    return scope if scope and lookup.most is not None and lookup.most <= FEW else None


def joins_itself(lookup: S.Lookup) -> bool:
    """Whether the lookup reads the items more than once."""
    return one_on_a_line(lookup) is None and _by_line(lookup) is None


def looked_up(items: DataFrame, lookup: S.Lookup, wanted: str | None, carry: tuple[str, ...], name: str, atoms: list[int]) -> DataFrame:
    """The items with a column of what a lookup that isn't `unordered` finds for those of some atoms, in order; null or empty for nothing."""
    if one_on_a_line(lookup):
        best = F.col("best.found")
        return nearest(items, lookup, wanted, carry).withColumn(name, F.when(F.col("best").isNotNull(), F.array(best))).drop("best")
    scope = scope_of(lookup)
    if scope is None:
        return paired(items, lookup, wanted, carry, name, atoms)
    if lookup.most == 1 and not scope.by_item:
        return first_to_one_side(items, lookup, scope, wanted, carry, name)
    if _by_line(lookup):
        return few(items, lookup, scope, wanted, carry, name)
    return shared_lines(items, lookup, scope, wanted, carry, name, atoms)


def _served(name: str, act: int, prov: int) -> Column:
    """What a lookup found, as entries of one provider."""
    return F.transform(name, lambda f: F.struct(F.lit(act).alias("act"), F.lit(prov).alias("prov"), f.alias("found")))


def with_finds(items: DataFrame, atoms: list[S.Atom], ops: tuple[str, ...], carry: tuple[str, ...]) -> tuple[DataFrame, list[tuple[str, dict[int, list[tuple[int, int]]]]]]:
    """The items with a column for each lookup of these operations, and its name with the numbers of the actions and providers of each atom that use it."""
    asked = uses(atoms, ops)
    names = [f"found_{i}" for i in range(len(asked))]
    items = firsts_elsewhere(items, [(lookup, wanted, name) for (lookup, wanted), name in zip(asked, names, strict=True) if unordered(lookup)], carry)
    for name, ((lookup, wanted), by_atom) in zip(names, asked.items(), strict=True):
        if not unordered(lookup):
            items = looked_up(items, lookup, wanted, carry, name, list(by_atom))
    return items, list(zip(names, asked.values(), strict=True))


def with_operands(items: DataFrame, atoms: list[S.Atom], ops: tuple[str, ...], carry: tuple[str, ...], only: Column | None = None) -> DataFrame:
    """The items (`only` some of them) with a column `ops` of what the providers of these operations found.

    An entry has the numbers of action and provider and the columns to carry; entries of one
    provider are in its order.
    """
    parts: dict[int, list[Column]] = {}
    items, found = with_finds(items, atoms, ops, carry)
    for name, by_atom in found:
        for n, at in by_atom.items():
            parts.setdefault(n, []).extend(_served(name, act, prov) for act, prov in at)
    if only is not None:
        items = items.where(only)
    kinds = ",".join(f"{c}:{items.schema[c].dataType.simpleString()}" for c in carry)
    kind = f"array<struct<act:int,prov:int,found:struct<{kinds}>>>"
    each = [(n, F.concat(*(F.coalesce(p.cast(kind), F.array().cast(kind)) for p in own))) for n, own in parts.items()]
    served = reduce(lambda a, ne: a.when(F.col("atom") == ne[0], ne[1]), each[1:], F.when(F.col("atom") == each[0][0], each[0][1])) if each else F.lit(None).cast(kind)
    return items.withColumn("ops", served).drop(*(name for name, _ in found))
