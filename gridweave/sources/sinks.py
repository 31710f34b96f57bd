"""Records out: CSV as text and as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.operators.transforms import KEYS


def csv_line(values: Column, sep: str = ",", missing: str = "") -> Column:
    """An array of strings as one CSV line: quoted where a separator, a quote or a line end asks for it."""

    def field(v: Column) -> Column:
        v = F.coalesce(v, F.lit(missing))
        quote = F.contains(v, F.lit(sep)) | v.rlike(r'["\r\n]')
        return F.when(quote, F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)

    return F.array_join(F.transform(values, field), sep)


def csv_lines(records: DataFrame, sep: str = ",", missing: str = "", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The records as CSV lines in column `line`, keys kept."""
    names = [c for c in records.columns if c not in keys]
    return records.select(*keys, csv_line(F.array(*(F.col("`" + n.replace("`", "``") + "`") for n in names)), sep, missing).alias("line"))


def write_csv(records: DataFrame, path: str, sep: str = ",", missing: str = "", keys: tuple[str, ...] = KEYS) -> None:
    """Files that, one after the other, are one CSV text: the header, then the records in the order of tables and records; CRLF line ends."""
    names = [c for c in records.columns if c not in keys]
    lines = csv_lines(records, sep, missing, keys)
    # Null keys sort first, so the header begins the first file.
    head = records.sparkSession.range(1).select(*(F.lit(None).cast(lines.schema[k].dataType).alias(k) for k in keys), F.lit(_header(names, sep)).alias("line"))
    head.union(lines).repartitionByRange(*keys).sortWithinPartitions(*keys).select("line").write.text(path, lineSep="\r\n")


def _header(names: list[str], sep: str) -> str:
    return sep.join('"' + n.replace('"', '""') + '"' if any(c in n for c in (sep, '"', "\n", "\r")) else n for n in names)


def csv_text(records: DataFrame, sep: str = ",", missing: str = "", keys: tuple[str, ...] = KEYS) -> str:
    """The CSV text of a small result, with its header; CRLF line ends."""
    names = [c for c in records.columns if c not in keys]
    lines = [r.line for r in csv_lines(records, sep, missing, keys).orderBy(*keys).collect()]
    return "".join(f"{x}\r\n" for x in [_header(names, sep), *lines])
