"""From tables and a pattern to one DataFrame of records."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.operators import fixed, transforms
from gridweave.operators.items import Atoms, item_arrays
from gridweave.operators.lookups import kinds_for
from gridweave.operators.records import ERROR, LOCAL_CELLS, Options, fields, identified, literals_of, named_again, parts_of, records_of, static_names
from gridweave.plans import spec as S
from gridweave.plans.rtl import Bindings, compile_pattern


def attributes(fields: DataFrame) -> list[str]:
    """The attributes of records in long form, in the order they are met, tables by id."""
    first = fields.groupBy("attr").agg(F.min(F.struct("table_id", "visit")).alias("met"))
    return [r.attr for r in first.orderBy("met").select("attr").collect()]


def wide_members(found: DataFrame, schema: list[str]) -> DataFrame:
    """A column for each attribute of the schema, read from each record's own members."""
    # Names and values are listed once a record, backwards: the first place of a name is then its last member's, and 0 is none's.
    listed = lambda n: F.reverse(F.transform("members", lambda m: m[n])).alias(f"{n}s")
    values = [F.get("vals", (F.array_position("attrs", a) - 1).cast("int")).alias(f"c{i}") for i, a in enumerate(schema)]
    return found.select("table_id", "rec_no", listed("attr"), listed("val")).select("table_id", "rec_no", *values).toDF("table_id", "rec_no", *schema)


def wide(fields: DataFrame, schema: list[str]) -> DataFrame:
    """A column for each attribute of the schema; of members with one attribute the last counts."""
    names = [f"c{i}" for i in range(len(schema))]
    values = [F.max_by("val", F.when(F.col("attr") == a, F.col("pos"))).alias(n) for n, a in zip(names, schema, strict=True)]
    made = fields.groupBy("table_id", "rec_no").agg(*values) if values else fields.select("table_id", "rec_no").distinct()
    return made.toDF("table_id", "rec_no", *schema)


def extract(
    tables: DataFrame,
    pattern: S.Table | str,
    schema: list[str] | None = None,
    bindings: Bindings | None = None,
    options: Options | None = None,
    missing: Callable[[str], str | None] | None = None,
    table_id: str = "table_id",
    grid: str = "grid",
    keep: bool = True,
    local_cells: int | None = LOCAL_CELLS,
    widths: dict[str, int] | None = None,
) -> DataFrame:
    """The records of all tables that match: table_id, rec_no and a string column for each attribute.

    tables has a row for each table: an id and the grid, array<array<string>>.  Rows whose
    ids are null or repeated are tables of their own, each with records from 0 on.  With a
    schema nothing runs before the result is used; without, one job finds the attributes.
    Settings that split fields look at the data once more, unless `widths` names the number
    of parts of each field that splits (others stay one); then more parts are an error.
    Cells may be structs with a field `text`; tests bound with whole=True see the others.
    Tables that don't match give no records.  If no table gives any, the only attribute is
    the template's first.  With options of on_error="null" the last column is _error.
    """
    options = options or Options()
    pattern = compile_pattern(pattern, bindings) if isinstance(pattern, str) else pattern
    tables = identified(tables, table_id, grid)
    arrays, rows = None, None
    if schema is None:
        found = records_of(tables, pattern, options, keep, local_cells)
        found = found.persist() if keep else found
        schema = attributes(fields(found, options)) or [options.template.replace("%i", "1")]
        rows = found
    else:
        arrays, rows = parts_of(tables, pattern, options, keep, local_cells)
    if options.on_error == "null":
        schema = [*(a for a in schema if a != ERROR), ERROR]
    static = static_names(Atoms(pattern).atoms)
    # Where the pattern alone tells places and names, a record's columns are read off its cells.
    layout = fixed.layout_of(tables, pattern) if arrays and rows is None else None
    known = fixed.wide(tables, layout, options, schema) if layout else None
    parts = [known if known is not None else wide_members(arrays(not static), schema)] if arrays else []
    if rows is not None:
        parts.append(wide_members(rows, schema) if static else wide(fields(rows, options), schema))
    out = named_again(reduce(DataFrame.union, parts))
    if missing:
        out = transforms.with_missing(out, missing)
    return transforms.applied(out, pattern.settings, widths=widths)


def matching(tables: DataFrame, pattern: S.Table | str, bindings: Bindings | None = None, grid: str = "grid") -> DataFrame:
    """The tables with a column `matched`."""
    from gridweave.operators.match import match

    pattern = compile_pattern(pattern, bindings) if isinstance(pattern, str) else pattern
    return match(tables, pattern, grid).withColumn("matched", F.col("cells").isNotNull()).drop("cells")


def inspected(tables: DataFrame, pattern: S.Table | str, bindings: Bindings | None = None, table_id: str = "table_id", grid: str = "grid") -> DataFrame:
    """(table_id, matched, items, actions, constants) for each table: what matching makes of it.

    items: how many each kind has; actions: how many actions their items have, inherited ones
    that a kind doesn't allow left out; constants: how many different texts the pattern's
    actions name.  Zero for tables that don't match.
    """
    pattern = compile_pattern(pattern, bindings) if isinstance(pattern, str) else pattern
    atoms = Atoms(pattern).atoms
    found = item_arrays(tables, pattern, table_id, grid)
    items = F.coalesce("items", F.array())
    of_kind = lambda kind: F.size(F.filter(items, lambda i: i["kind"] == kind))
    acts = F.array(*(F.lit(sum(not x.inherited or a.kind in kinds_for(x.op)[0] for x in a.actions)) for a in atoms), F.lit(0))
    total = F.aggregate(items, F.lit(0), lambda n, i: n + F.get(acts, i["atom"]))
    kinds = F.struct(*(of_kind(k).alias(k.lower()) for k in (S.VAL, S.ATTR, S.AUX)))
    return found.select("table_id", F.col("items").isNotNull().alias("matched"), kinds.alias("items"), total.alias("actions"), F.when(F.col("items").isNotNull(), len(literals_of(atoms))).otherwise(0).alias("constants"))
