"""Extraction from streams of tables.

A table is one row, so its records depend on that row alone: every micro-batch is extracted
by itself with the batch operators, and appended.  The schema must be given, as it can't be
found from tables yet to come, and so must `widths` if a setting splits fields.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from gridweave.operators.extract import extract
from gridweave.plans import spec as S
from gridweave.plans.rtl import compile_pattern


def extract_stream(tables: DataFrame, pattern: S.Table | str, schema: list[str], sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None, **options) -> StreamingQuery:
    """Start a query that gives the records of each micro-batch of tables to `sink(records, batch)`.

    A batch whose sink failed is given again with its number, so a sink that replaces what it
    wrote for a number is exactly-once.
    """
    pattern = compile_pattern(pattern) if isinstance(pattern, str) else pattern
    if options.get("widths") is None and any(s[0] == "SPLIT" or s[0] == "FIELD" and not s[3] for s in pattern.settings):
        raise ValueError("a stream of records has one schema: give the widths of fields that split")
    options = {"widths": {}} | options

    def batch(rows: DataFrame, number: int) -> None:
        sink(extract(rows, pattern, schema, keep=False, **options), number)

    return tables.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to a folder of its own, replacing what an earlier attempt left."""
    return lambda records, number: records.write.mode("overwrite").parquet(f"{path}/batch={number}")
