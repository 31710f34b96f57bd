"""Records of small tables: a table stays one row, its items and records are arrays.

Lookups are expressions on the array of the table's items, so nothing is shuffled; the work
of a lookup grows with the square of the items, which the limit on cells bounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.operators import fixed
from gridweave.operators import records as R
from gridweave.operators.items import Atoms, item_arrays, named_tables
from gridweave.operators.lookups import condition_of, uses, wanted_kind
from gridweave.plans import spec as S


def possible(pattern: S.Table) -> bool:
    """Whether the pattern asks for nothing that only Python can answer: that needs rows."""
    atoms = Atoms(pattern).atoms
    terms = [t for a in atoms for x in a.actions for p in x.providers if isinstance(p, S.Lookup) for branch in p.condition for t in branch]
    python = [t for t in terms if isinstance(t, S.PairTest) and not t.columnar or isinstance(t, S.Test) and t.kind == "ext" and not t.columnar]
    calls = [step for a in atoms for step in a.extract if step[0] == "CALL" and not step[2]]
    return not python and not calls


def _finder(items: Column, x, atoms: list[S.Atom], ops: tuple[str, ...], carry: tuple[str, ...], get):
    """found(atom, act, prov): what a provider finds among the items for item x, in order; get(item) gives an item's columns."""
    allowed = {(n, act, prov): lookup for (lookup, _), by_atom in uses(atoms, ops).items() for n, at in by_atom.items() for act, prov in at}
    numbers = {id(a): n for n, a in enumerate(atoms)}
    nothing = F.array().cast("array<struct<" + ",".join(f"{c}:{'bigint' if c == 'seq' else 'string'}" for c in carry) + ">>")

    def found(atom: S.Atom, act: int, prov: int) -> Column:
        lookup = allowed.get((numbers[id(atom)], act, prov))
        if lookup is None:
            return nothing
        wanted = wanted_kind(lookup, atom.actions[act].op)
        kinds = [n for n, a in enumerate(atoms) if wanted is None or a.kind == wanted]
        sign = -1 if lookup.order.startswith("-") else 1
        places = ("col", "row") if lookup.order.endswith("^") else ("row", "col")

        def fits(c: Column) -> Column:
            meets = condition_of(lookup.condition, x, get(c))
            return meets if len(kinds) == len(atoms) else c["atom"].isin(kinds) & meets

        entry = lambda c: F.struct(*((c[p] * sign).alias(f"o{i}") for i, p in enumerate(places, 1)), c["idx"].alias("o3"), c["seq"].alias("o4"), F.struct(*(get(c)(n).alias(n) for n in carry)).alias("found"))
        entries = F.transform(F.filter(items, fits), entry)
        if lookup.most == 1:
            return F.transform(F.filter(F.array(F.array_min(entries)), lambda e: e.isNotNull()), lambda e: e["found"])
        ordered = F.sort_array(entries)
        return F.transform(ordered if lookup.most is None else F.slice(ordered, 1, lookup.most), lambda e: e["found"])

    return found


def _with(item: Column, **columns: Column) -> Column:
    for name, value in columns.items():
        item = item.withField(name, value)
    return item


def records(tables: DataFrame, pattern: S.Table, options: R.Options, table_id: str, grid: str, named: bool = False) -> DataFrame:
    """(table_id, rec_no, members) of all matching tables, checked.  named: every member has its attribute, records without any are left out."""
    tables = named_tables(tables, table_id, grid)
    layout = fixed.layout_of(tables, pattern)
    made = fixed.arrays_of_records(tables, layout, options) if layout else arrays_of_records(item_arrays(tables, pattern), pattern, options)
    sound = F.transform("records", lambda r: F.struct(R.checked_members(r["members"], options).alias("members")))
    if not named:
        return _each(made.withColumn("records", sound))
    return _each(made.withColumn("records", R.named_arrays(sound, options))).where(F.size("members") > 0)


def records_of_items(out: DataFrame, pattern: S.Table, options: R.Options) -> DataFrame:
    """(table_id, rec_no, members) of tables (table_id, items)."""
    return _each(arrays_of_records(out, pattern, options))


def _each(made: DataFrame) -> DataFrame:
    return made.select("table_id", F.posexplode_outer("records").alias("rec_no", "r")).where("r is not null").select("table_id", "rec_no", "r.members")


def arrays_of_records(out: DataFrame, pattern: S.Table, options: R.Options) -> DataFrame:
    """(table_id, records) of tables (table_id, items): an array of structs with the members."""
    atoms = Atoms(pattern).atoms
    items = F.col("items")
    # Items are written down anew only where a value or an attribute is what lookups find; else these are read off the item.
    strings, found_attributes = R.has_strings(atoms), R.has_found_attributes(atoms)

    def get(item: Column):
        def of(n: str) -> Column:
            if n == "attr" and not found_attributes:
                return attribute(item)
            return item["s"] if n == "val" and not strings else item[n]

        return of

    def valued(item: Column) -> Column:
        x = get(item)
        return R.by_atom(atoms, lambda a: R.value_of(a, x, R.strings_of(_finder(items, x, atoms, R._STRING_OPS, ("s",), get))), x("s"), x)

    def attribute(item: Column) -> Column:
        x = get(item)
        return R.by_atom(atoms, lambda a: R.attribute_of(a, _finder(items, x, atoms, ("AVP",), ("val",), get)), F.lit(None).cast("string"), x)

    if strings:
        out = out.withColumn("items", F.transform(items, lambda i: _with(i, val=valued(i))))
    if found_attributes:
        out = out.withColumn("items", F.transform(items, lambda i: _with(i, attr=attribute(i))))

    groups = R.grouping(pattern, options)
    literals = R.literals_of(atoms)
    has = [n for n, a in enumerate(atoms) if R.first_record(a) is not None]
    places = ("row", "col") if options.actions_by == "row" else ("col", "row")
    nothing = F.array().cast(R.JOINS)
    has_joins = not groups and any(x.op == "JOIN" for a in atoms for x in a.actions)

    def record(item: Column) -> Column:
        x = get(item)
        found = _finder(items, x, atoms, ("REC", "JOIN"), ("seq", "attr", "val"), get)
        own = [x(places[0]).alias("o1"), x(places[1]).alias("o2"), x("seq").alias("seq"), R.by_atom(atoms, lambda a: R.members_of(a, x, found, literals), F.array().cast(R.MEMBERS), x).alias("members")]
        if has_joins:
            own.append(R.by_atom(atoms, lambda a: R.joins_of(a, found), nothing, x).alias("joins"))
        if groups:
            own += [x(n).alias(n) for n in groups.by]
        return F.struct(*own)

    made = F.sort_array(F.transform(F.filter(items, lambda i: i["atom"].isin(has)), record))
    out = out.select("table_id", made.alias("records"))
    if groups:
        all_, same = F.col("records"), lambda a, b: reduce(Column.__and__, (a[n] == b[n] for n in groups.by), F.lit(True))
        heads = F.filter(all_, lambda r: ~F.exists(all_, lambda q: (q["seq"] < r["seq"]) & same(q, r)))
        out = out.withColumn("records", F.transform(heads, lambda r: F.struct(r["seq"].alias("seq"), R.merged_members(r, F.filter(all_, lambda q: (q["seq"] > r["seq"]) & same(q, r)), groups.drop).alias("members"))))
    elif has_joins:
        return R.joined_arrays(out)
    return out
