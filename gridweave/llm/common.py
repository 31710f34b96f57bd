"""What the operators of this subpackage share: tables, scratch space, Arrow helpers."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Up to this many rows of ids a join's side is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 1 << 20


def checkpoint_root(spark: SparkSession) -> str:
    """The folder all executors share.  The cluster names it in spark.checkpoint.dir;
    only where that is unset and the master is local (tests, a laptop) does a local folder
    take its place, which goes with the process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="spark-checkpoint-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


#: How many rows and bytes of texts a Python worker gets at once.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to BATCH_ROWS and BATCH_BYTES, unless it has smaller ones or its own.

    Ten thousand whole texts, the default, are tens of megabytes in the JVM and in each worker.
    """
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(rows, "10000") == "10000":
        spark.conf.set(rows, str(BATCH_ROWS))
        spark.conf.set(size, str(BATCH_BYTES))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there: computed once, no lineage."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def sized(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of few columns for a join with a wide one: broadcast if it has at most so many rows."""
    return F.broadcast(rows) if rows.count() <= most else rows


def ids_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so that other columns can't clash and aren't scanned."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def utf8(texts: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of a string array, one after the other, without making Python strings of them."""
    return (x.as_buffer().to_pybytes() if x.is_valid else None for x in texts)


def strings(texts: pa.Array) -> Iterator[str | None]:
    """The strings of an array, one after the other."""
    return (x.as_py() for x in texts)


def train_share(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus
