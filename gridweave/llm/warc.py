"""WARC archives and the external merge of their index runs (operator 1).

Writing: of captures with equal payloads of at least REVISIT_BYTES bytes the one with the
smallest id becomes a response record, the others revisit records without the payload.
Records are built as columns, dealt to partitions of about PART_BYTES of payload, and written
by Spark's text writer, whose separator is the two line ends that close a record, so archives
go to any store Spark writes to.  A partition is rolled into archives by number of records:
as many as have ARCHIVE_BYTES on average, for rows are dealt at random.

Reading: each archive is parsed by its records' Content-Length; a response's payload is
held against its digest.  Each archive gives one locally sorted run of captures.  Runs are
cut at key borders; each key range gets a sorted slice of every run, and a loser tree
merges the slices by URL key, time and id, so the ranges in order are the globally ordered
capture history.  A task merges its ranges one after the other and holds the slices of one,
as Arrow columns.  Borders are quantiles of the whole sort key, time and id included, so the
captures of a frequent URL spread over several ranges.

Defined cases: a null payload counts as empty; a null URL or time is written as an empty
field; a null id is written as an empty one and sorts first; ties are ordered by id; repeated
rows are records of their own, and all rows with the smallest id of a payload are responses;
empty tables write and read no archive.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm.common import cut, sized

REVISIT_BYTES = 100
RECORDS_A_FILE = 2000
ARCHIVE_BYTES = 16 << 20
PART_BYTES = 1 << 30
#: About how many rows a key range has, unless there would be more than MAX_RANGES.
RANGE_ROWS = 2000
MAX_RANGES = 1 << 14
_KEYS = 512
_OUT = 1 << 13
_END = "\r\n"
CAPTURE = "page_id long, url string, url_key string, captured string, record_type string, refers_to long, payload_bytes long, payload_digest string"
_FIELDS = ("page_id", "url", "url_key", "captured", "record_type", "refers_to", "payload_bytes", "payload_digest")
_PLACE = pa.struct([("page_id", pa.int64()), ("url", pa.string()), ("url_key", pa.string()), ("captured", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def url_key(url: Column) -> Column:
    """The sort key of a URL: reversed host, then path and query; scheme, user, www., port and fragment are left out."""
    rest = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://|#.*$", "")
    host = F.regexp_replace(F.regexp_extract(rest, r"^([^/?]*)", 1), r"^[^@]*@|^www\.|:\d*$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_extract(rest, r"^[^/?]*(.*)$", 1))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", captured: Column | None = None, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(deal, record): the WARC record of every page, without the line ends that close it, and its row's number."""
    payload = F.coalesce(F.col(f"`{payload_col}`"), F.lit("")).cast("binary")
    # The number says where a record goes; it is given before anything is shuffled.
    rows = pages.select(F.monotonically_increasing_id().alias("deal"), F.col(f"`{id_col}`").cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col(f"`{url_col}`"), F.lit("")), r"[\r\n]", "").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"), (F.lit("") if captured is None else F.coalesce(captured, F.lit(""))).alias("captured"))
    first = rows.where(F.col("bytes") >= revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    # Written first, so that the join deals both sides anew and can split a frequent payload.
    first = cut(first)
    known = rows.join(sized(first), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    name = lambda i: F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.lit("")), F.lit(">"))
    body = F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("payload"))
    header = F.concat(
        F.lit(f"WARC/1.1{_END}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(f"{_END}WARC-Record-ID: "), name(F.col("page_id")),
        F.lit(f"{_END}WARC-Target-URI: "), F.col("url"), F.lit(f"{_END}WARC-Date: "), F.col("captured"),
        F.lit(f"{_END}WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit(f"{_END}X-Payload-Length: "), F.col("bytes").cast("string"),
        F.when(revisit, F.concat(F.lit(f"{_END}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{_END}WARC-Refers-To: "), name(F.col("first")))).otherwise(""),
        F.lit(f"{_END}Content-Type: text/html{_END}Content-Length: "), F.octet_length(body).cast("string"), F.lit(_END + _END),
    )
    return known.select("deal", F.concat(header.cast("binary"), body).cast("string").alias("record"))


def write_archives(pages: DataFrame, path: str, records_a_file: int = RECORDS_A_FILE, archive_bytes: int = ARCHIVE_BYTES, payload_col: str = "html", part_bytes: int = PART_BYTES, **options) -> None:
    """Write the pages as gzip-compressed WARC files under `path`, of about so many bytes of payload and so many records at most."""
    count, total = pages.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col(f"`{payload_col}`"))), F.lit(0))).first()
    parts = max(pages.sparkSession.sparkContext.defaultParallelism, -(-total // part_bytes))
    roll = max(1, min(records_a_file, archive_bytes * count // max(1, total)))
    dealt = records(pages, payload_col=payload_col, **options).repartition(parts, "deal").select("record")
    dealt.write.option("lineSep", _END + _END).option("compression", "gzip").option("maxRecordsPerFile", roll).text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple]:
    """The captures of one archive, in its order.  A payload that its digest doesn't fit is an error."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:60]!r}")
        head = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode().partition(":")
            head[key.lower()] = value.strip()
        payload = stream.read(int(head["content-length"]))
        digest = head["warc-payload-digest"].removeprefix("sha256:")
        number = lambda k: int(x) if (x := head.get(k, "").removeprefix("<urn:page:").removesuffix(">")) else None
        kind = head["warc-type"]
        if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload of {head['warc-record-id']} doesn't fit its digest")
        size = len(payload) if kind == "response" else int(head["x-payload-length"])
        yield number("warc-record-id"), head["warc-target-uri"], head["warc-date"], kind, number("warc-refers-to"), size, digest


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
    for batch in batches:
        for i in range(batch.num_rows):
            path, content = batch.column("path")[i].as_py(), batch.column("content")[i].as_buffer()
            captures = parse(io.BufferedReader(pa.BufferReader(content)) if not path.endswith(".gz") else gzip.GzipFile(fileobj=pa.BufferReader(content)))
            while rows := list(islice(captures, _OUT)):
                arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), *arrays], ["run", "page_id", "url", "captured", "record_type", "refers_to", "payload_bytes", "payload_digest"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives under `path`: run (the archive), page_id, url, url_key, captured, record_type, refers_to, payload_bytes, payload_digest."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    read = files.mapInArrow(_read, "run string, page_id long, url string, captured string, record_type string, refers_to long, payload_bytes long, payload_digest string")
    return read.select("run", "page_id", "url", url_key(F.col("url")).alias("url_key"), "captured", "record_type", "refers_to", "payload_bytes", "payload_digest")


def sort_key(row: dict) -> tuple:
    return row["url_key"], row["captured"], row["page_id"] is not None, row["page_id"] or 0


class LoserTree:
    """k-way merge of sorted runs: each inner node keeps the loser of its match, so the next
    row costs one comparison a level."""

    def __init__(self, runs: Iterable[Iterator], key):
        self.runs = [iter(r) for r in runs]
        self.key = key
        self.k = len(self.runs)
        self.heads = [self._next(i) for i in range(self.k)]
        self.loser = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _next(self, run: int):
        row = next(self.runs[run], None)
        return None if row is None else (self.key(row), run, row)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x[:2] < y[:2])

    def _play(self, run: int) -> None:
        """Send a run up from its leaf; an empty node, met while the tree is built, keeps it."""
        node = (run + self.k) // 2
        while node:
            other = self.loser[node]
            if other < 0:
                self.loser[node] = run
                return
            if self._beats(other, run):
                self.loser[node], run = run, other
            node //= 2
        self.loser[0] = run

    def __iter__(self):
        while self.k:
            run = self.loser[0]
            head = self.heads[run]
            if head is None:
                return
            yield head[2]
            self.heads[run] = self._next(run)
            self._play(run)


def _slices(batches: Iterator[pa.RecordBatch], borders: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Sort each run as it comes, and cut it at the borders: one row for each slice."""
    for batch in batches:
        rows = batch.to_pylist()
        by_run: dict[str, list[dict]] = {}
        for row in rows:
            by_run.setdefault(row.pop("run"), []).append(row)
        out: list[tuple[int, str, list[dict]]] = []
        for run, own in by_run.items():
            own.sort(key=sort_key)
            at = None
            for row in own:
                part = bisect_right(borders, sort_key(row))
                if part != at:
                    out.append((part, run, []))
                    at = part
                out[-1][2].append(row)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.list_(_PLACE))], ["part", "run", "rows"])


def _keys(rows: pa.StructArray, at: int) -> Iterator[tuple]:
    """(sort key, number) of each row of a slice whose first has the number `at`; only some are made at once."""
    for low in range(0, len(rows), _KEYS):
        part = rows.slice(low, _KEYS)
        fields = zip(*(part.field(f).to_pylist() for f in ("url_key", "captured", "page_id")), strict=True)
        yield from (((key, time, page is not None, page or 0), at + low + i) for i, (key, time, page) in enumerate(fields))


def _merged(part: int, slices: list[pa.StructArray]) -> Iterator[pa.RecordBatch]:
    """One range: its slices merged and numbered."""
    starts = accumulate(map(len, slices), initial=0)
    order = [number for _, number in LoserTree([_keys(s, at) for s, at in zip(slices, starts)], lambda x: x[0])]
    rows = pa.concat_arrays(slices)
    for low in range(0, len(order), _OUT):
        taken = rows.take(pa.array(order[low : low + _OUT], pa.int64()))
        places = pa.array(range(low, low + len(taken)), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(taken), pa.int32()), places, *(taken.field(f) for f in _FIELDS)], ["part", "place", *_FIELDS])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slices come in the order of their ranges; each range goes out as soon as the next begins."""
    current, slices = None, []
    for batch in batches:
        parts, rows = batch.column("part").to_pylist(), batch.column("rows")
        for i, part in enumerate(parts):
            if part != current:
                if slices:
                    yield from _merged(current, slices)
                current, slices = part, []
            slices.append(rows[i].values)
    if slices:
        yield from _merged(current, slices)


def merge_index(captures: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """The global capture history: part and place give the order by URL key, time and id."""
    captures = cut(captures)
    n = captures.count()
    parts = min(MAX_RANGES, -(-n // rows))
    borders: list[tuple] = []
    if parts > 1:
        # About 8 keys a range, chosen by hash, place the borders; every row is merged whatever they are.
        chance = F.pmod(F.xxhash64("url_key", "captured", "page_id"), F.lit(1 << 20)) / float(1 << 20)
        some = sorted((r.url_key, r.captured, r.page_id is not None, r.page_id or 0) for r in captures.where(chance < 8 * parts / n).select("url_key", "captured", "page_id").collect())
        borders = sorted({some[i * len(some) // parts] for i in range(1, parts)}) if some else []
    sliced = captures.mapInArrow(partial(_slices, borders=borders), f"part int, run string, rows array<struct<{_ddl()}>>")
    return sliced.repartition("part").sortWithinPartitions("part").mapInArrow(_merge, f"part int, place long, {CAPTURE}")


def _ddl() -> str:
    return ", ".join(":".join(x.split()) for x in CAPTURE.split(", "))
