"""Sharding by a consistent-hash ring with virtual nodes and bounded loads (operator 3).

Keys and virtual nodes are hashed to the cells of a ring.  A key goes to the next virtual
node clockwise; a shard takes no more rows than its bound, and what overflows continues
clockwise to the next virtual node whose shard has room, cell by cell and round by round.
Rows of one cell are numbered in a fixed order, so which of them overflow is determined.

The route of a row depends on its cell and its number there alone.  The counts of the cells
(CELLS numbers whatever the input) are read once and the rounds played on them; the result
says for intervals of each cell's numbers which shard they go to, at most one interval a
cell plus one a shard, and is broadcast.

Rows are numbered in groups: a cell with more than a GROUPSth of all rows (one frequent key,
say) is cut by a hash of the whole row, and of a row that is repeated that often the copies,
which can't be told apart, are dealt out.  Groups are numbered one after the other, rows
within one by their values.  So the result depends on the rows alone, not on how they are
partitioned, and no group has more than about twice a GROUPSth of them.

With `slack` e a shard's bound is ceil((1 + e) n / shards).  With slack 0 the bounds are
floor or ceil of n / shards, so that counts are at most one apart; then one more shard moves
more rows than it takes, since full shards pass rows on along the ring: from 40 to 41 some
4 % of 200,000 rows move, 1.8 times the new shard's (of 1,000 rows 6 %); with slack 0.1 it
is 1.2 times as many, with slack 0.5 none but the new shard's.

Defined cases: a null key has a place on the ring like any other, repeated rows are counted
each, an empty table gives an empty result, and with fewer rows than shards some are empty.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.common import cut

CELL_BITS = 14
CELLS = 1 << CELL_BITS
GROUPS = 1 << 13
_HEAVY = 1 << 20
NODES = 64
OVERHEAD = 16


def ring(shards: int, nodes: int = NODES, cells: int = CELLS) -> dict[int, int]:
    """Cell -> shard for every virtual node; a taken cell sends the later node to the next free one."""
    if shards * nodes > cells // 2:
        raise ValueError(f"{shards} shards of {nodes} virtual nodes need more than {cells} cells")
    taken: dict[int, int] = {}
    for shard in range(shards):
        for node in range(nodes):
            at = int.from_bytes(hashlib.blake2b(f"{shard}#{node}".encode(), digest_size=8).digest(), "big") % cells
            while at in taken:
                at = (at + 1) % cells
            taken[at] = shard
    return taken


def bounds(n: int, shards: int, slack: float = 0.0) -> list[int]:
    """The most rows that each shard takes."""
    if slack > 0:
        return [-int(-(1 + slack) * n // shards)] * shards
    return [n // shards + (s < n % shards) for s in range(shards)]


def routes(counts: dict[int, int], shards: int, nodes: int = NODES, cells: int = CELLS, slack: float = 0.0) -> list[dict[str, int]]:
    """The rounds of the ring: intervals [first, last) of a cell's row numbers with their shard and first slot.

    In a round each cell's waiting rows ask one virtual node, in clockwise order of the
    cells; the shard takes the lower numbers as far as it has room, the rest asks the next
    node in the next round.
    """
    taken = ring(shards, nodes, cells)
    places = sorted(taken)
    owner = [taken[p] for p in places]
    room, filled = bounds(sum(counts.values()), shards, slack), [0] * shards
    waiting, at = [], 0
    for cell in sorted(counts):
        while at < len(places) and places[at] < cell:
            at += 1
        waiting.append((cell, at % len(places), 0, counts[cell]))
    out = []
    while waiting:
        rest = []
        for cell, node, first, last in waiting:
            shard = owner[node]
            take = min(last - first, room[shard] - filled[shard])
            if take:
                out.append({"cell": cell, "first": first, "last": first + take, "shard": shard, "slot": filled[shard]})
                filled[shard] += take
            if first + take < last:
                following = (node + 1) % len(places)
                while filled[owner[following]] >= room[owner[following]]:
                    following = (following + 1) % len(places)
                rest.append((cell, following, first + take, last))
        waiting = rest
    return out


def cell_of(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - CELL_BITS).cast("int")


def _grouped(placed: DataFrame, counts: dict[int, int], groups: int) -> DataFrame:
    """The rows (row, cell, hash, deal) with `spread`: which group of its cell a row is in."""
    spark = placed.sparkSession
    most = max(1, sum(counts.values()) // groups)
    crowded = [(cell, -(-n // most)) for cell, n in sorted(counts.items()) if n > most]  # `groups` cells at most
    if not crowded:
        return placed.withColumn("spread", F.lit(0).cast("long"))
    pieces = F.broadcast(spark.createDataFrame(crowded, "cell int, pieces int"))
    # Of rows that are repeated so often there are `groups` at most, too.
    heavy = placed.join(pieces, "cell").groupBy("cell", "hash").count().where(F.col("count") > most)
    heavy = heavy.select("cell", "hash", F.row_number().over(Window.partitionBy("cell").orderBy("hash")).alias("rank"), F.ceil(F.col("count") / most).alias("salts"))
    known = placed.join(pieces, "cell", "left").join(F.broadcast(cut(heavy)), ["cell", "hash"], "left")
    one = F.pmod("hash", F.coalesce("pieces", F.lit(1)))
    return known.select("row", "cell", F.when(F.col("rank").isNull(), one).otherwise(F.col("rank") * _HEAVY + F.pmod("deal", F.col("salts"))).cast("long").alias("spread"))


def assign(rows: DataFrame, key: str, shards: int, nodes: int = NODES, slack: float = 0.0, groups: int = GROUPS) -> DataFrame:
    """The rows with columns `shard` and `slot` (gapless from 0 in each shard).

    The rows are written once to the shared folder, so pass keys and measures, not texts.
    """
    spark = rows.sparkSession
    row = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    placed = cut(rows.select(row.alias("row"), cell_of(F.col(f"`{key}`")).alias("cell"), F.xxhash64(row).alias("hash"), F.monotonically_increasing_id().alias("deal")))
    counts = {r.cell: r["count"] for r in placed.groupBy("cell").count().collect()}  # CELLS rows at most
    grouped = cut(_grouped(placed, counts, groups))
    sizes = grouped.groupBy("cell", "spread").count()
    before = Window.partitionBy("cell").orderBy("spread").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("cell", "spread", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    found = routes(counts, shards, nodes, slack=slack)
    routed = spark.createDataFrame([(r["cell"], r["first"], r["last"], r["shard"], r["slot"]) for r in found], "from_cell int, first long, last long, shard int, base long")
    number = F.row_number().over(Window.partitionBy("cell", "spread").orderBy("row")).cast("long") - 1
    # Both tables are bounded by the ring: CELLS + 3 * groups offsets, CELLS + shards routes.
    numbered = grouped.withColumn("number", number).join(F.broadcast(offsets), ["cell", "spread"]).withColumn("number", F.col("number") + F.col("offset"))
    here = (F.col("cell") == F.col("from_cell")) & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("last"))
    return numbered.join(F.broadcast(routed), here).select("row.*", "shard", (F.col("base") + F.col("number") - F.col("first")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", nodes: int = NODES, slack: float = 0.0) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot); size is the text's UTF-8 bytes plus OVERHEAD."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return assign(rows, "doc_id", shards, nodes, slack)
