"""Tables as rows of (table_id, grid): from CSV files, delimited texts and DataFrames."""

from __future__ import annotations

import csv
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRID = "array<array<string>>"


def parse_csv(text: str | None) -> list[list[str]] | None:
    """The records of a CSV text; empty lines are left out.  ValueError for none, or for ragged ones."""
    if text is None:
        return None
    rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    if not rows:
        raise ValueError("an empty table")
    if any(len(r) != len(rows[0]) for r in rows):
        raise ValueError("rows of different lengths")
    return rows


def _lenient(text: str | None) -> list[list[str]] | None:
    try:
        return parse_csv(text)
    except ValueError:
        return None


def csv_grid(text: Column, strict: bool = True) -> Column:
    """The grid of a CSV text; a text that isn't a table fails, or is null if not strict."""
    parse = parse_csv if strict else _lenient
    return F.arrow_udf(lambda texts: pa.array((parse(x.as_py()) for x in texts), pa.list_(pa.list_(pa.string()))), GRID)(text)


def read_csv_grids(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(table_id, grid): one table for each file, named by its path."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("table_id"), csv_grid(F.col("value"), strict).alias("grid"))


def fill_merged(grid: Column, regions: Column) -> Column:
    """The grid with the first cell of each merged region in all of its cells.

    regions: array of structs (top, left, bottom, right), both ends included.  Of regions
    that overlap the first counts; cells may be texts or structs.
    """

    def cell(own: Column, row: Column, col: Column) -> Column:
        covers = F.filter(regions, lambda r: (r["top"] <= row) & (r["left"] <= col) & (r["bottom"] >= row) & (r["right"] >= col))
        region = F.get(covers, F.lit(0))
        return F.when(F.size(covers) > 0, F.get(F.get(grid, region["top"]), region["left"])).otherwise(own)

    return F.transform(grid, lambda cells, row: F.transform(cells, lambda own, col: cell(own, row, col)))


def read_csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """(table_id, part, row, cells): one table for each file, row by row, for `extract_rows`.

    Files may be of any size: they are read in splits, `part` and `row` order a file's rows.
    Lines are rows, so texts with line breaks aren't for this; empty lines are left out.
    """
    lines = spark.read.text(path).where("value <> ''")
    place = F.col("_metadata.file_block_start").cast("long").alias("part")
    read = lines.select(F.input_file_name().alias("table_id"), place, F.monotonically_increasing_id().alias("row"), F.col("value"))
    # Lines without a quote are split in the JVM; a quoted text's marks are doubled within it.
    quoted = F.col("value").contains('"')
    texts = F.regexp_extract_all(F.col("value"), F.lit(r'(?:^|,)("(?:[^"]|"")*+"|[^,]*+)'), F.lit(1))
    bare = lambda t: F.when(t.startswith('"') & t.endswith('"') & (F.length(t) > 1), F.replace(F.substring(t, F.lit(2), F.length(t) - 2), F.lit('""'), F.lit('"'))).otherwise(t)
    cells = F.when(quoted, F.transform(texts, bare)).otherwise(F.split("value", ",", -1))
    return read.select("table_id", "part", "row", cells.alias("cells"))


def read_csv_records(spark: SparkSession, path: str, schema: list[str] | None = None) -> DataFrame:
    """Records from CSV files, all of one schema: given, or from the first row of each.  What a short row lacks is empty."""
    read = spark.read.options(multiLine=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, mode="PERMISSIVE")
    if schema is not None:
        found = read.schema(", ".join(f"c{i} string" for i in range(len(schema)))).csv(path)
    else:
        found = read.option("header", True).csv(path)
        schema = [c.strip() for c in found.columns]
    return found.fillna("").toDF(*schema)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by key to as many partitions as the session has for shuffles.

    Their number stays, as tables are few bytes and much work.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def grid_of_rows(df: DataFrame, keys: list[str], order: list[str], columns: list[str], header: bool = False) -> DataFrame:
    """One table for each key: its rows in order, the given columns as texts; null is the empty text.

    With a header the first row holds the columns' names.
    """
    row = F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    made = dealt(df, *keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, row.alias("_row")))).alias("_rows"))
    grid = F.transform("_rows", lambda r: r["_row"])
    head = F.array(F.array(*map(F.lit, columns)))
    key = F.col(keys[0]) if len(keys) == 1 else F.to_json(F.struct(*keys))
    return made.select(key.alias("table_id"), (F.concat(head, grid) if header else grid).alias("grid"))


def grid_of_text(text: Column, rows_by: str = "\n", cells_by: str = "|") -> Column:
    """The grid of a delimited text."""
    from gridweave.functions.text import quoted, trimmed

    return F.transform(F.split(text, quoted(rows_by), -1), lambda r: F.transform(F.split(r, quoted(cells_by), -1), trimmed))


def cells(tables: DataFrame, table_id: str = "table_id", grid: str = "grid") -> DataFrame:
    """(table_id, row, col, text, blank, multiline, indent) of every cell."""
    from gridweave.functions.text import is_blank

    rows = tables.select(F.col(table_id).alias("table_id"), F.posexplode(grid).alias("row", "_cells"))
    each = rows.select("table_id", "row", F.posexplode("_cells").alias("col", "text")).withColumn("text", F.coalesce("text", F.lit("")))
    return each.withColumns({"blank": is_blank(F.col("text")), "multiline": F.contains("text", F.lit("\n")), "indent": F.length("text") - F.length(F.ltrim("text"))})
