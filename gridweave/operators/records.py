"""Actions and records: from items and what they found to the finished records.

Strings are filled and extended first, then attributes are given, then records are made,
then joined.  Except for joins everything is an expression on the item and its operands, or
one join for attributes and values; a join of records, where an earlier one decides what is
left for a later one, is a group if all of a line find each other, and else folded within
each line that the joins of a table can't leave.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.operators.items import Atoms, items, kind_and_tags, most_cells, most_items
from gridweave.operators.lookups import common_columns, joins_itself, unordered, wanted_kind, with_finds, with_operands
from gridweave.operators.match import cell_text, is_formatted
from gridweave.plans import spec as S

#: The field that says what is wrong with a record, if errors don't fail the query.
ERROR = "_error"
_STRING_OPS = ("FILL", "PREFIX", "SUFFIX")
_MEMBER = "struct<seq:bigint,attr:string,val:string>"
MEMBERS = f"array<{_MEMBER}>"
_ARROW_MEMBER = pa.struct([("seq", pa.int64()), ("attr", pa.string()), ("val", pa.string())])
JOINS = "array<struct<found:array<bigint>,drop:array<int>>>"


@dataclass(frozen=True)
class Options:
    """How records are made: `actions_by` and `schema_by` are "row" or "column", and "record" or "position".

    on_error: "raise" lets records that contradict each other (an attribute twice, anchors of
    different names) fail the query; with "null" such a record has no fields but ERROR.
    """

    actions_by: str = "row"
    schema_by: str = "record"
    template: str = "$a_%i"
    on_error: str = "raise"

    def __post_init__(self):
        if "%i" not in self.template:
            raise ValueError("a template holds %i")
        if self.actions_by not in ("row", "column") or self.schema_by not in ("record", "position"):
            raise ValueError("actions_by is row or column, schema_by record or position")
        if self.on_error not in ("raise", "null"):
            raise ValueError("on_error is raise or null")

    def name(self, n: Column) -> Column:
        return F.replace(F.lit(self.template), F.lit("%i"), n.cast("string"))


def by_atom(atoms: list[S.Atom], of, default: Column, x=F.col) -> Column:
    """An expression for each atom that has one; x gives an item's columns."""
    own = [(n, e) for n, atom in enumerate(atoms) if (e := of(atom)) is not None]
    return reduce(lambda a, ne: a.when(x("atom") == ne[0], ne[1]), own[1:], F.when(x("atom") == own[0][0], own[0][1])).otherwise(default) if own else default


def literals_of(atoms: list[S.Atom]) -> dict[str, int]:
    texts = (p.text for a in atoms for x in a.actions for p in x.providers if isinstance(p, S.Literal))
    return {t: i for i, t in enumerate(dict.fromkeys(texts))}


def _in_ops(atom: S.Atom, act: int, prov: int) -> Column:
    """What one provider of an action found, in order, read from column `ops`."""
    return F.transform(F.filter("ops", lambda o: (o["act"] == act) & (o["prov"] == prov)), lambda o: o["found"])


def strings_of(found):
    """found, but of what a provider found the first strings only."""
    return lambda atom, act, prov: F.coalesce(F.transform(found(atom, act, prov), lambda o: o["s"]), F.array().cast("array<string>"))


def _strings(atom: S.Atom, act: int, found) -> Column:
    """The strings that a string action joins; found gives those of a provider."""
    each = []
    for prov, p in enumerate(atom.actions[act].providers):
        each.append(F.array(F.lit(p.text)) if isinstance(p, S.Literal) else found(atom, act, prov))
    return F.concat(*each) if each else F.array().cast("array<string>")


def has_strings(atoms: list[S.Atom]) -> bool:
    return any(a.op in _STRING_OPS for atom in atoms for a in atom.actions)


def has_found_attributes(atoms: list[S.Atom]) -> bool:
    return any(isinstance(p, S.Lookup) for atom in atoms for a in atom.actions if a.op == "AVP" for p in a.providers)


def value_of(atom: S.Atom, x, found) -> Column | None:
    """An item's string after the FILL, PREFIX and SUFFIX actions, which read other items' first strings; found gives these."""
    acts = [(i, a) for i, a in enumerate(atom.actions) if a.op in _STRING_OPS]
    if not acts or atom.kind not in (S.VAL, S.ATTR):
        return None
    out = x("s")
    for act, action in acts:
        own = _strings(atom, act, found)
        text = F.array_join(own, action.text)
        match action.op:
            case "FILL":
                out = text
            case "PREFIX":
                out = F.when(F.size(own) > 0, F.concat(text, F.lit(action.text), out)).otherwise(out)
            case "SUFFIX":
                out = F.when(F.size(own) > 0, F.concat(out, F.lit(action.text), text)).otherwise(out)
    return out


def attribute_of(atom: S.Atom, found) -> Column | None:
    """What the first AVP action with an operand gives, by the operand's final value."""
    if atom.kind != S.VAL:
        return None
    given = [F.lit(a.providers[0].text) if isinstance(a.providers[0], S.Literal) else F.get(found(atom, act, 0), F.lit(0))["val"] for act, a in enumerate(atom.actions) if a.op == "AVP"]
    return F.coalesce(*given) if given else None


def valued(found: DataFrame, atoms: list[S.Atom]) -> DataFrame:
    """The items with `val`, their final string."""
    if not has_strings(atoms):
        return found.withColumn("val", F.col("s"))
    value = by_atom(atoms, lambda a: value_of(a, F.col, strings_of(_in_ops)), F.col("s"))
    return with_operands(found, atoms, _STRING_OPS, ("s",)).withColumn("val", value).drop("ops")


def attributed(values: DataFrame, atoms: list[S.Atom]) -> DataFrame:
    """The items with `attr`."""
    if has_found_attributes(atoms):
        values = with_operands(values, atoms, ("AVP",), ("val",))
    return values.withColumn("attr", by_atom(atoms, lambda a: attribute_of(a, _in_ops), F.lit(None).cast("string"))).drop("ops")


def first_record(atom: S.Atom) -> int | None:
    """The action that makes the atom's record: its first REC."""
    return next((i for i, a in enumerate(atom.actions) if a.op == "REC"), None) if atom.kind == S.VAL else None


def members_of(atom: S.Atom, x, found, literals: dict[str, int]) -> Column | None:
    """The members of the record that an item of this atom makes, itself first."""
    act = first_record(atom)
    if act is None:
        return None
    member = lambda seq, attr, val: F.struct(seq.cast("long").alias("seq"), attr.cast("string").alias("attr"), val.alias("val"))
    parts = [F.array(member(x("seq"), x("attr"), x("val")))]
    for prov, p in enumerate(atom.actions[act].providers):
        match p:
            case S.Literal(text):
                parts.append(F.array(member(F.lit(-1 - literals[text]), F.lit(None), F.lit(text))))
            case S.Pair(attr, value):
                parts.append(F.array(member(F.lit(None), F.lit(attr), F.lit(value))))
            case _:
                parts.append(F.coalesce(found(atom, act, prov), F.array()))
    return F.concat(*(p.cast(MEMBERS) for p in parts))


def joins_of(atom: S.Atom, found) -> Column | None:
    """For each JOIN action of a record's anchor: what it found, and the positions it leaves out."""
    acts = [i for i, a in enumerate(atom.actions) if a.op == "JOIN"]
    if first_record(atom) is None or not acts:
        return None
    others = lambda act: F.flatten(F.array(*(F.transform(found(atom, act, prov), lambda o: o["seq"]) for prov in range(len(atom.actions[act].providers)))))
    drop = lambda act: F.array(*map(F.lit, atom.actions[act].drop)).cast("array<int>")
    return F.array(*(F.struct(F.coalesce(others(act), F.array().cast("array<bigint>")).alias("found"), drop(act).alias("drop")) for act in acts))


@dataclass(frozen=True)
class Grouping:
    """Joins whose records fall into groups by some columns; the first of a group takes in the others."""

    by: tuple[str, ...]
    drop: tuple[int, ...]


#: What cells have in common that all find each other so, or of which each finds all behind it.
_GROUPS = {"BW": ("subtable", "col"), "SC": ("subtable", "col"), "RT": ("row", "subrow"), "SR": ("row", "subrow"), "COL": ("col",), "ROW": ("row",), "ST": ("subtable",), "NCL": ()}


def grouping(pattern: S.Table, options: Options) -> Grouping | None:
    """The groups that the pattern's joins make, if a record finds all others of its line, or of those with its string, or all behind it.

    For that every record is the only one of its cell and has the same unlimited JOIN.  The
    first record of a line then leaves no other for a later one.
    """
    anchors = [(c, a) for c in S.contents(pattern) for a in S.atoms_of(c) if first_record(a) is not None]
    joins = [[x for x in a.actions if x.op == "JOIN"] for _, a in anchors]
    if options.actions_by != "row" or not anchors or any(len(own) != 1 for own in joins) or not all(isinstance(c, S.Atom | S.Conditional) for c, _ in anchors):
        return None
    providers, drop = joins[0][0].providers, joins[0][0].drop
    if len(providers) != 1 or any((own[0].providers, own[0].drop) != (providers, drop) for own in joins):
        return None
    lookup = providers[0]
    if not isinstance(lookup, S.Lookup) or lookup.most is not None or lookup.order != S.ROW_MAJOR or len(lookup.condition) != 1:
        return None
    terms = lookup.condition[0]
    text = ("s",) if S.SameText() in terms else ()
    places = [t for t in terms if t != S.SameText()]
    if not places:
        return Grouping(text, drop)
    by = _GROUPS.get(places[0].name) if isinstance(places[0], S.Spatial) and len(places) == 1 else None
    return None if by is None else Grouping(by + text, drop)


def join_lines(atoms: list[S.Atom]) -> list[str]:
    """Columns in which a record and all that its joins find are equal: no join leaves such a line."""
    lookups = [p for a in atoms if first_record(a) is not None for x in a.actions if x.op == "JOIN" for p in x.providers if isinstance(p, S.Lookup)]
    return sorted(set.intersection(*map(common_columns, lookups))) if lookups else []


def merged_members(first: Column, others: Column, drop: tuple[int, ...]) -> Column:
    """The members of a record that takes in others: theirs but for some positions, and of each attribute the first."""
    kept = (lambda r: F.filter(r["members"], lambda m, i: ~i.isin(list(drop)))) if drop else (lambda r: r["members"])
    every = F.concat(first["members"], F.flatten(F.transform(others, kept)))

    def fresh(members: Column) -> Column:
        attrs = F.transform(members, lambda m: m["attr"])
        named = F.exists(members, lambda m: m["attr"].isNotNull())
        return F.when(named, F.filter(members, lambda m, i: m["attr"].isNull() | (F.array_position(attrs, m["attr"]) == i + 1))).otherwise(members)

    return F.element_at(F.transform(F.array(every), fresh), 1)


def made(named: DataFrame, atoms: list[S.Atom], options: Options, groups: Grouping | None = None) -> DataFrame:
    """(table_id, o1, o2, seq, members, joins): the records in the order of their anchors, members with attribute and value.

    With groups these have the columns that make them instead of joins; without, `joins` and
    those of `join_lines`.
    """
    literals = literals_of(atoms)
    has = [n for n, a in enumerate(atoms) if first_record(a) is not None]
    places = ("row", "col") if options.actions_by == "row" else ("col", "row")
    full = with_operands(named, atoms, ("REC",) if groups else ("REC", "JOIN"), ("seq", "attr", "val"), F.col("atom").isin(has) if has else F.lit(False))
    members = by_atom(atoms, lambda a: members_of(a, F.col, _in_ops, literals), F.array().cast(MEMBERS))
    rest = list(groups.by) if groups else [by_atom(atoms, lambda a: joins_of(a, _in_ops), F.array().cast(JOINS)).alias("joins"), *join_lines(atoms)]
    return full.select("table_id", F.col(places[0]).alias("o1"), F.col(places[1]).alias("o2"), "seq", members.alias("members"), *rest)


def joined_by_groups(records: DataFrame, groups: Grouping) -> DataFrame:
    """(table_id, rec_no, members) after a join by groups."""
    row = F.struct("o1", "o2", "seq", "members")
    found = records.groupBy("table_id", *groups.by).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    first = F.col("rows")[0]
    others = F.slice("rows", 2, F.greatest(F.lit(1), F.size("rows")))
    return numbered(found.select("table_id", first["o1"].alias("o1"), first["o2"].alias("o2"), first["seq"].alias("seq"), merged_members(first, others, groups.drop).alias("members")))


def _fold(seqs: list[int], joins: list[tuple[list[int], list[int]]], joins_of: list[int], members: list[range], attrs: list[str | None] | None) -> list[tuple[int, list[int]]]:
    """Let each record, in order, take in those its joins found, as far as both are still there.

    Members are numbers, attrs theirs, if any has one.  The records left, each with its members.
    """
    alive = dict(zip(seqs, map(list, members), strict=True))
    at = 0
    for seq, n in zip(seqs, joins_of, strict=True):
        for found, drop in joins[at : at + n]:
            if seq not in alive:
                break
            own = alive[seq]
            for other in found:
                if other in alive and other != seq:
                    taken = alive.pop(other)
                    own += [m for i, m in enumerate(taken) if i not in drop] if drop else taken
            if attrs:
                seen: set[str] = set()
                alive[seq] = [m for m in own if attrs[m] is None or not (attrs[m] in seen or seen.add(attrs[m]))]
        at += n
    return [(i, alive[seq]) for i, seq in enumerate(seqs) if seq in alive]


def _lengths(lists: pa.Array) -> list[int]:
    return lists.value_lengths().fill_null(0).to_pylist()


def _folded(tables: pa.Array) -> tuple[list[int], pa.Array, pa.Array]:
    """How many records each table has after its joins, those records' numbers, and their members.  Only numbers become Python's, texts stay where they are."""
    records = tables.flatten()
    seqs = records.field("seq").to_pylist()
    members, joins = records.field("members"), records.field("joins")
    flat, each = members.flatten(), joins.flatten()
    attr = flat.field("attr")
    attrs = attr.to_pylist() if attr.null_count < len(attr) else None
    ends = np.cumsum([0, *_lengths(members)]).tolist()
    own = [range(a, b) for a, b in zip(ends, ends[1:], strict=False)]
    pairs = list(zip(each.field("found").to_pylist(), each.field("drop").to_pylist(), strict=True))
    n_joins = _lengths(joins)
    join_ends = np.cumsum([0, *n_joins]).tolist()
    counts, kept, order, sizes, at = [], [], [], [0], 0
    for n in _lengths(tables):
        left = _fold(seqs[at : at + n], pairs[join_ends[at] : join_ends[at + n]], n_joins[at : at + n], own[at : at + n], attrs)
        counts.append(len(left))
        for i, taken in left:
            kept.append(at + i)
            order += taken
            sizes.append(len(order))
        at += n
    return counts, pa.array(kept, pa.int64()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat.take(pa.array(order, pa.int64())))


def joined_arrays(tables: DataFrame) -> DataFrame:
    """(table_id, records: array<struct<members>>) after the joins of tables (table_id, records), the records in order."""
    kind = pa.list_(pa.struct([("members", pa.list_(_ARROW_MEMBER))]))

    def joined_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, _, members = _folded(batch.column("records"))
            made = pa.StructArray.from_arrays([members.cast(pa.list_(_ARROW_MEMBER))], ["members"])
            yield pa.RecordBatch.from_arrays([batch.column("table_id"), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), made).cast(kind)], ["table_id", "records"])

    given = tables.schema["table_id"].dataType.simpleString()
    return tables.select("table_id", "records").mapInArrow(joined_batches, f"table_id {given}, records array<struct<members:{MEMBERS}>>")


def joined_tables(tables: DataFrame) -> DataFrame:
    """(table_id, rec_no, o1, o2, seq, members) after the joins of tables, or of lines of them, (table_id, records), the records in order."""

    def joined_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, kept, members = _folded(batch.column("records"))
            records = batch.column("records").flatten()
            at = np.repeat(np.arange(len(counts)), counts)
            numbers = pa.array([i for n in counts for i in range(n)], pa.int32())
            places = [records.field(n).take(kept).cast(pa.int64()) for n in ("o1", "o2", "seq")]
            yield pa.RecordBatch.from_arrays([batch.column("table_id").take(pa.array(at)), numbers, *places, members.cast(pa.list_(_ARROW_MEMBER))], ["table_id", "rec_no", "o1", "o2", "seq", "members"])

    kind = tables.schema["table_id"].dataType.simpleString()
    return tables.select("table_id", "records").mapInArrow(joined_batches, f"table_id {kind}, rec_no int, o1 long, o2 long, seq long, members {MEMBERS}")


def joined(records: DataFrame, lines: list[str]) -> DataFrame:
    """(table_id, rec_no, members) after the joins, which are folded line by line."""
    row = F.struct("o1", "o2", "seq", "members", "joins")
    return numbered(joined_tables(records.groupBy("table_id", *lines).agg(F.sort_array(F.collect_list(row)).alias("records"))))


def numbered(records: DataFrame) -> DataFrame:
    order = Window.partitionBy("table_id").orderBy("o1", "o2", "seq")
    return records.select("table_id", (F.row_number().over(order) - 1).alias("rec_no"), "members")


def fields(records: DataFrame, options: Options) -> DataFrame:
    """(table_id, rec_no, pos, attr, val, visit): every member of every record with its attribute.

    Unnamed anchors share the template's first name if no anchor of the table is named, and
    stay without one (and drop out) otherwise.  Another unnamed member is named by the
    position at which it is met first.  An attribute met twice in a record, or two names for
    the anchors of a table, are errors.
    """
    each = records.select("table_id", "rec_no", F.posexplode("members").alias("pos", "m")).select("table_id", "rec_no", "pos", "m.seq", F.col("m.attr").alias("given"), "m.val")
    table = Window.partitionBy("table_id")
    anchor = F.when(F.col("pos") == 0, F.col("given"))
    each = each.withColumn("low", F.min(anchor).over(table)).withColumn("high", F.max(anchor).over(table))
    visit = F.struct("rec_no", "pos") if options.schema_by == "record" else F.struct("pos", "rec_no")
    unnamed = F.col("given").isNull()
    item = Window.partitionBy("table_id", F.coalesce("seq", F.lit(0)))
    lone = F.max((F.col("pos") == 0) & unnamed & F.col("low").isNull()).over(item)
    met = F.min_by("pos", F.when((F.col("pos") > 0) & unnamed, visit)).over(item)
    each = each.withColumn("lone", lone).withColumn("met", met)
    attr = F.coalesce(
        "given",
        F.when(F.col("pos") == 0, F.when(F.col("low").isNull(), options.name(F.lit(1)))),
        F.when(F.col("pos") > 0, F.when(F.col("lone") & F.col("seq").isNotNull(), options.name(F.lit(1))).otherwise(options.name(F.col("met") + 1))),
    )
    named = each.withColumn("attr", attr).where("attr is not null")
    differ, message = F.col("low") != F.col("high"), F.concat(F.lit("anchors have different attributes: "), F.col("low"), F.lit(", "), F.col("high"))
    if options.on_error == "null":
        known = F.col("given") == ERROR
        first = named.where(~F.coalesce(differ, F.lit(False)) | known | (F.col("pos") == 0))
        named = first.withColumn("val", F.when(differ & ~F.coalesce(known, F.lit(False)), message).otherwise(F.col("val"))).withColumn("attr", F.when(differ, F.lit(ERROR)).otherwise(F.col("attr")))
        wrong = F.lit(None)
    else:
        wrong = F.when(differ, F.raise_error(message))
    # Anchors come first in a schema, then attributes as they are met.
    first, second = ("rec_no", "pos") if options.schema_by == "record" else ("pos", "rec_no")
    met_at = F.when(F.col("pos") == 0, F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("b"))).otherwise(F.struct(F.col(first).alias("a"), F.col(second).alias("b")))
    return named.select("table_id", "rec_no", "pos", "attr", F.coalesce(wrong.cast("string"), F.col("val")).alias("val"), met_at.alias("visit"))


def checked_members(members: Column, options: Options) -> Column:
    """The members of a record; two of the same attribute are an error."""
    names = F.transform(F.filter(members, lambda m: m["attr"].isNotNull()), lambda m: m["attr"])
    twice = F.size(names) != F.size(F.array_distinct(names))
    message = F.concat(F.lit("an attribute occurs twice in a record: "), F.array_join(names, ", "))
    if options.on_error == "null":
        wrong = F.array(F.struct(F.lit(None).cast("long").alias("seq"), F.lit(ERROR).alias("attr"), message.alias("val")))
    else:
        wrong = F.raise_error(message)
    return F.when(twice, wrong.cast(MEMBERS)).otherwise(members)


def checked(records: DataFrame, options: Options) -> DataFrame:
    """The records; one with two members of the same attribute is an error."""
    return records.withColumn("members", checked_members(F.col("members"), options))


def _bound(value: Column, then) -> Column:
    """An expression of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def named_arrays(records: Column, options: Options) -> Column:
    """The records (array of struct with members) of one table with the names that `fields` gives; members without one are left out."""
    anchor = lambda r: F.get(r["members"], F.lit(0))
    visit = ("n", "p") if options.schema_by == "record" else ("p", "n")

    def of_records(own: Column) -> Column:
        given = F.transform(own, lambda r: anchor(r)["attr"])
        place = lambda n, m, p: F.struct(m["seq"].alias("seq"), *((n if v == "n" else p).alias(v) for v in visit))
        unnamed = lambda r, n: F.filter(F.transform(r["members"], lambda m, p: F.when((p > 0) & m["attr"].isNull(), place(n, m, p))), lambda x: x.isNotNull())
        met = _bound(F.sort_array(F.flatten(F.transform(own, unnamed))), lambda all_: F.filter(all_, lambda x, i: (i == 0) | (x["seq"] != F.get(all_, i - 1)["seq"])))
        places = F.map_from_entries(F.transform(met, lambda x: F.struct(x["seq"], x["p"])))
        low = F.array_min(given)
        # The anchors of tables in which none is named share a name wherever they are members.
        lone = F.when(low.isNull(), F.transform(own, lambda r: anchor(r)["seq"]))
        return _bound(F.struct(low.alias("low"), F.array_max(given).alias("high"), lone.alias("lone"), places.alias("places")), lambda known: F.transform(own, lambda r: F.struct(_named_members(r["members"], known, options).alias("members"))))

    return _bound(records, of_records)


def _named_members(members: Column, known: Column, options: Options) -> Column:
    first = options.name(F.lit(1))
    other = lambda m: F.when(F.coalesce(F.array_contains(known["lone"], m["seq"]), F.lit(False)), first).otherwise(options.name(F.element_at(known["places"], m["seq"]) + 1))
    attr = lambda m, p: F.when(m["attr"].isNotNull(), m["attr"]).when(p == 0, F.when(known["low"].isNull(), first)).otherwise(other(m))
    differ, message = F.coalesce(known["low"] != known["high"], F.lit(False)), F.concat(F.lit("anchors have different attributes: "), known["low"], F.lit(", "), known["high"])
    member = lambda a, v: F.struct(F.lit(None).cast("long").alias("seq"), a.alias("attr"), v.alias("val"))
    named = F.filter(F.transform(members, lambda m, p: member(attr(m, p), m["val"])), lambda m: m["attr"].isNotNull())
    if options.on_error != "null":
        return F.when(differ, F.raise_error(message).cast(MEMBERS)).otherwise(named)
    told = F.filter(F.transform(members, lambda m, p: F.when((m["attr"] == ERROR) | (p == 0) & m["attr"].isNotNull(), member(F.lit(ERROR), F.when(m["attr"] == ERROR, m["val"]).otherwise(message)))), lambda m: m.isNotNull())
    return F.when(differ, told).otherwise(named)


def static_names(atoms: list[S.Atom]) -> bool:
    """Whether the pattern itself names every member, and all anchors alike: then records need no naming."""
    names = []
    for atom in atoms:
        if atom.kind != S.VAL:
            continue
        given = [a.providers[0] for a in atom.actions if a.op == "AVP"]
        if not given or not isinstance(given[-1], S.Literal):
            return False
        if first_record(atom) is not None:
            names.append(given[0].text if isinstance(given[0], S.Literal) else None)
    providers = [p for a in atoms for x in a.actions if x.op == "REC" for p in x.providers]
    others = any(isinstance(p, S.Literal) or isinstance(p, S.Lookup) and p.kind not in (None, S.VAL) for p in providers)
    return not others and None not in names and len(set(names)) <= 1


#: Tables of up to so many cells are worked on as arrays, larger ones as rows.
LOCAL_CELLS = 64


def identified(tables: DataFrame, table_id: str, grid: str) -> DataFrame:
    """(table_id, grid) of each input row, table_id a struct of the row's id and a number that no other row has.

    Lookups, joins and windows go by both, so rows whose ids are null or equal are tables of
    their own.  The number comes from the row's place in its input partition.
    """
    key = F.struct(F.col(f"`{table_id}`").alias("id"), F.monotonically_increasing_id().alias("row"))
    return tables.select(key.alias("table_id"), F.col(f"`{grid}`").alias("grid"))


def named_again(df: DataFrame) -> DataFrame:
    """The rows with the tables' ids as they were given."""
    return df.withColumn("table_id", F.col("table_id.id"))


def records(tables: DataFrame, pattern: S.Table, options: Options | None = None, table_id: str = "table_id", grid: str = "grid", keep: bool = True, local_cells: int | None = LOCAL_CELLS) -> DataFrame:
    """(table_id, rec_no, members) of all matching tables; members not named by the pattern have no attribute yet.

    A table of up to `local_cells` cells, and parts of delimited cells, stays one row: its
    items and records are arrays, and nothing is shuffled.  The items of larger tables become rows, which lookups join.  Both
    give the same; 0 has all tables done as rows, None all as arrays, with half the plan, for
    tables known to be small.  keep: the items are persisted where
    several joins read them.  Every input row is a table, whatever its id.
    """
    return named_again(records_of(identified(tables, table_id, grid), pattern, options, keep, local_cells))


def records_of(tables: DataFrame, pattern: S.Table, options: Options | None = None, keep: bool = True, local_cells: int | None = LOCAL_CELLS) -> DataFrame:
    """What `records` gives for tables (table_id, grid) of different ids."""
    parts = parts_of(tables, pattern, options or Options(), keep, local_cells)
    return reduce(DataFrame.union, [p for p in (parts[0] and parts[0](False), parts[1]) if p is not None])


def parts_of(tables: DataFrame, pattern: S.Table, options: Options, keep: bool = True, local_cells: int | None = LOCAL_CELLS):
    """The records of the tables done as arrays, a function of whether their members are to be named, and of those done as rows; None for no such part."""
    from gridweave.operators import local

    table_id, grid = "table_id", "grid"
    arrays = lambda own: lambda named: local.records(own, pattern, options, table_id, grid, named)
    if local_cells is None and local.possible(pattern):
        return arrays(tables), None
    if not local_cells or local_cells < 0 or not local.possible(pattern):
        return None, checked(_by_rows(tables, pattern, options, table_id, grid, keep), options)
    made = most_items(pattern, F.col(grid), cell_text(is_formatted(tables, grid)))
    if made is None and (most_cells(pattern) or local_cells + 1) <= local_cells:
        return arrays(tables), None  # larger tables don't match
    cells = F.size(F.col(grid)) * F.coalesce(F.size(F.get(F.col(grid), F.lit(0))), F.lit(0))
    small = F.coalesce(cells <= local_cells, F.lit(True))
    if made is not None:  # delimited cells may have many items each
        small = small & F.coalesce(made <= local_cells, F.lit(True))
    return arrays(tables.where(small)), checked(_by_rows(tables.where(~small), pattern, options, table_id, grid, keep), options)


def _by_rows(tables: DataFrame, pattern: S.Table, options: Options, table_id: str, grid: str, keep: bool) -> DataFrame:
    return records_of_items(items(tables, pattern, table_id, grid, spans=False), pattern, options, keep)


def named_items(found: DataFrame, pattern: S.Table, keep: bool, grouped: bool = False) -> DataFrame:
    """The items, dealt by table or line, with `val` and `attr`.  grouped: joins are groups, for which nothing is looked up."""
    numbered_atoms = Atoms(pattern)
    atoms = numbered_atoms.atoms
    lookups = [p for a in atoms for x in a.actions for p in x.providers if isinstance(p, S.Lookup)]
    # Lookups along lines by windows read the items once, others join them with themselves.
    sought = [p for a in atoms for x in a.actions if not (grouped and x.op == "JOIN") for p in x.providers if isinstance(p, S.Lookup)]
    hold = (lambda df: df.persist()) if keep and any(map(joins_itself, sought)) else (lambda df: df)
    lines = sorted(set.intersection(*map(common_columns, lookups))) if lookups else []
    # Dealt and sorted without what their atoms tell.
    found = found.drop("kind", "tags").repartition("table_id", *lines)
    if lookups and all(map(unordered, lookups)):
        found = found.sortWithinPartitions("table_id", *lines)
    kind, tags = kind_and_tags(numbered_atoms, F.col("atom"))
    found = hold(found.withColumn("kind", kind).withColumn("tags", tags))
    named = attributed(valued(found, atoms), atoms)
    if has_strings(atoms) or has_found_attributes(atoms):
        named = hold(named)
    return named


def records_of_items(found: DataFrame, pattern: S.Table, options: Options, keep: bool) -> DataFrame:
    """(table_id, rec_no, members) of items as rows."""
    atoms = Atoms(pattern).atoms
    groups = grouping(pattern, options)
    named = named_items(found, pattern, keep, groups is not None)
    out = made(named, atoms, options, groups)
    if groups:
        return joined_by_groups(out, groups)
    return joined(out, join_lines(atoms)) if any(x.op == "JOIN" for a in atoms for x in a.actions) else numbered(out)


def told_members(atoms: list[S.Atom]) -> dict[int, list[tuple[str, tuple[int, int] | None]]] | None:
    """For each atom that makes records the attributes of their members, each with the action and provider that finds it, None for its own.

    None if the pattern doesn't tell them: if there are joins, or members of other kinds than
    one item, or if two might have one attribute.
    """
    if not static_names(atoms) or has_found_attributes(atoms) or any(x.op == "JOIN" for a in atoms for x in a.actions):
        return None
    attr = [next((x.providers[0].text for x in a.actions if x.op == "AVP"), None) for a in atoms]
    out = {}
    for n, a in enumerate(atoms):
        if (act := first_record(a)) is None:
            continue
        own: list[tuple[str, tuple[int, int] | None]] = [(attr[n], None)]
        for prov, p in enumerate(a.actions[act].providers):
            if not isinstance(p, S.Lookup) or p.most != 1 or len(p.condition) != 1:
                return None
            tags = [t for t in p.condition[0] if isinstance(t, S.Test) and t.kind == "tag"]
            fits = [attr[m] for m, c in enumerate(atoms) if c.kind == wanted_kind(p, "REC") and all((t.arg in c.tags) != t.negated for t in tags)]
            own += [(name, (act, prov)) for name in dict.fromkeys(fits)]
        if len({name for name, _ in own}) < len(own):
            return None
        out[n] = own
    return out


def wide_of_items(found: DataFrame, pattern: S.Table, options: Options, keep: bool, schema: list[str]) -> DataFrame | None:
    """(table_id, rec_no and the schema's columns) of items as rows, without lists of members, if the pattern tells these; else None."""
    atoms = Atoms(pattern).atoms
    told = told_members(atoms)
    if told is None or not schema:
        return None
    full, finds = with_finds(named_items(found, pattern, keep), atoms, ("REC",), ("attr", "val"))
    by = {(n, act, prov): name for name, by_atom in finds for n, at in by_atom.items() for act, prov in at}

    def value(name: str) -> Column:
        def of(n: int) -> Column | None:
            at = next((at for attr, at in told[n] if attr == name), False)
            if at is False:
                return None
            if at is None:
                return F.col("val")
            one = F.get(F.col(by[n, *at]), F.lit(0))
            return F.when(one["attr"] == name, one["val"])

        own = [(n, v) for n in told if (v := of(n)) is not None]
        return reduce(lambda a, nv: a.when(F.col("atom") == nv[0], nv[1]), own[1:], F.when(F.col("atom") == own[0][0], own[0][1])) if own else F.lit(None).cast("string")

    places = ("row", "col") if options.actions_by == "row" else ("col", "row")
    names = [f"c{i}" for i in range(len(schema))]
    made = full.where(F.col("atom").isin(list(told))).select("table_id", *places, "seq", *(value(a).alias(c) for a, c in zip(schema, names, strict=True)))
    rec_no = F.row_number().over(Window.partitionBy("table_id").orderBy(*places, "seq")) - 1
    return made.select("table_id", rec_no.alias("rec_no"), *names).toDF("table_id", "rec_no", *schema)


def record_fields(tables: DataFrame, pattern: S.Table, options: Options | None = None, table_id: str = "table_id", grid: str = "grid", keep: bool = True, local_cells: int | None = LOCAL_CELLS) -> DataFrame:
    """The records of all matching tables in long form: (table_id, rec_no, pos, attr, val, visit)."""
    return named_again(fields(records_of(identified(tables, table_id, grid), pattern, options, keep, local_cells), options or Options()))
