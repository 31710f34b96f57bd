"""Hard negatives by k-means inverted lists with exact bounds (operator 11).

Rows are dealt to inverted lists by their nearest centroid.  Centroids are fitted on
SAMPLE_ROWS rows at most; every row is indexed, and each list's radius, the largest distance
of a row to its centroid, is stored.  By Cauchy-Schwarz no row x of a list scores above
q.c + |q| r or below q.c - |q| r with a query q.  A query visits lists by descending upper
bound, a batch after the other, each four times as long; a list whose scores all lie outside
the query's windows is skipped, and the search ends when the next bound falls strictly below
the kth score found so far.  So results are exact, however good the centroids are.

A list is stored as tiles of some TILE_ROWS rows with radii of their own; a visit is a join
of blocks of queries with the tiles of a list, so a list of many equal rows is dealt to many
tasks.  Scores are integer inner products: float64 products where these are exact, Python's
integers otherwise; scores beyond 64 bits are held at their end.

Of all rows the driver sees the sample, and of each list its number of rows and its radius.

Defined cases: rows with a null label, vector or component, or one that isn't finite, take
no part, nor do rows without an id.  Rows of one id are separate rows, each another row to
the other.  Shorter vectors count as filled up with zeros; an empty one scores 0.  A
positive of negative score has no window, hence no negatives; one of score 0 allows 0 only.
Equal scores are ordered by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.common import cut

#: Rows that centroids are fitted on, at most.
SAMPLE_ROWS = 1 << 14
#: Centroids at most; below, as many as the root of the number of rows.
MAX_LISTS = 1024
ITERATIONS = 8
TILE_ROWS = 2048
#: Queries to a block.
BLOCK = 256
#: Lists visited in the first round.
FIRST_LISTS = 4
_STEP = 4
_EXACT = float(1 << 53)
_ENDS = (-(1 << 63), (1 << 63) - 1)
_ROUNDING = 1e-9
_ASKS = "list int, row long, label long, vec array<bigint>, windows array<struct<w:int,least:bigint,high:bigint>>"


@dataclass(frozen=True)
class Lists:
    """What every task knows of the inverted lists: MAX_LISTS rows at most."""

    centroids: np.ndarray
    radii: np.ndarray
    tiles: np.ndarray


def integers(rows: DataFrame, vec_id: str, vector: str, label: Column, scale: int) -> DataFrame:
    """(vec_id, label, vec): the rows that take part, components as floor(scale * x), all of one length."""
    vec = F.col(f"`{vector}`").cast("array<double>")
    named = rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), label.cast("long").alias("label"), vec.alias("vec"))
    named = named.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull())
    named = named.where(F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)))
    return named.withColumn("vec", F.transform("vec", lambda x: F.floor(x * scale).cast("long")))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a list column, shorter ones filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), flat.dtype)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products of all queries with all rows."""
    a, b = (float(np.abs(m.astype(np.float64)).max(initial=0)) for m in (queries, rows))
    if a * b * max(1, queries.shape[1]) < _EXACT:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    exact = queries.astype(object) @ rows.astype(object).T
    return np.clip(exact, *_ENDS).astype(np.int64)


def fitted(sample: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """k-means of the sample; a centroid that lost its rows stays where it was."""
    points = np.unique(sample, axis=0).astype(np.float64)
    random = np.random.default_rng(seed)
    centroids = points[random.choice(len(points), min(k, len(points)), replace=False)]
    points = sample.astype(np.float64)
    for _ in range(ITERATIONS):
        own = _nearest(points, centroids)[0]
        sums, n = np.zeros_like(centroids), np.bincount(own, minlength=len(centroids))
        np.add.at(sums, own, points)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


def _nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each point and how far it is."""
    own = np.concatenate([np.argmax(p @ centroids.T - (centroids**2).sum(1) / 2, axis=1) for p in np.array_split(points, max(1, len(points) // 4096))]) if len(points) else np.empty(0, np.int64)
    return own, np.sqrt(((points - centroids[own]) ** 2).sum(1))


def _dealt(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own, far = _nearest(_matrix(batch.column("vec"), centroids.shape[1]).astype(np.float64), centroids)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "vec_id", "label", "vec")), pa.array(own, pa.int32()), pa.array(far, pa.float64())], ["row", "vec_id", "label", "vec", "list", "far"])


def _tile(group: pa.Table, dim: int) -> pa.Table:
    """One row for the rows of a tile."""
    group = group.combine_chunks()
    column = lambda c: group.column(c).combine_chunks()
    packed = [column(c).to_numpy().astype("<i8").tobytes() for c in ("row", "vec_id", "label")]
    vectors = _matrix(column("vec"), dim).astype("<i8").tobytes()
    return pa.table({
        "list": pa.array([column("list")[0].as_py()], pa.int32()), "tile": pa.array([column("tile")[0].as_py()], pa.int32()),
        **{n: pa.array([p], pa.binary()) for n, p in zip(("rows", "ids", "labels", "vectors"), [*packed, vectors], strict=True)},
        "radius": pa.array([float(column("far").to_numpy().max())], pa.float64()),
    })


def _bounds(queries: np.ndarray, lists: Lists) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower bounds of the scores of each query in each list."""
    q = queries.astype(np.float64)
    middle, reach = q @ lists.centroids.T, np.sqrt((q**2).sum(1))[:, None] * lists.radii
    slack = (np.abs(middle) + reach) * _ROUNDING + _ROUNDING
    return middle + reach + slack, middle - reach - slack


def _asks(batches: Iterator[pa.RecordBatch], lists: Lists, first: int, last: int) -> Iterator[pa.RecordBatch]:
    """Which lists a query visits next: those from `first` to `last` by upper bound that can hold what it looks for."""
    for batch in batches:
        if not batch.num_rows:
            continue
        queries = _matrix(batch.column("vec"), lists.centroids.shape[1])
        high, low = _bounds(queries, lists)
        at, to = [], []
        for i, windows in enumerate(batch.column("windows").to_pylist()):
            order = np.argsort(-high[i], kind="stable")[first:last]
            needed = np.zeros(len(order), bool)
            for w in windows:
                needed |= (high[i][order] >= w["least"]) & (low[i][order] <= w["high"])
            visits = order[needed & (lists.tiles[order] > 0)]
            at += [i] * len(visits)
            to += visits.tolist()
        rows = batch.take(pa.array(at, pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), *(rows.column(c) for c in ("row", "label", "vec", "windows"))], ["list", "row", "label", "vec", "windows"])


def _visited(batches: Iterator[pa.RecordBatch], lists: Lists, k: int, same: bool) -> Iterator[pa.RecordBatch]:
    """The k best rows of a tile for each window of each query of a block."""
    dim = lists.centroids.shape[1]
    for batch in batches:
        out: list[tuple] = []
        for i in range(batch.num_rows):
            get = lambda c: batch.column(c)[i]  # noqa: B023, E731
            rows, ids, labels = (np.frombuffer(get(c).as_buffer(), "<i8") for c in ("rows", "ids", "labels"))
            tile = np.frombuffer(get("vectors").as_buffer(), "<i8").reshape(len(rows), dim)
            asks = get("asks").values
            queries = _matrix(asks.field("vec"), dim)
            high, low = _bounds(queries, Lists(lists.centroids[[get("list").as_py()]], np.array([get("radius").as_py()]), lists.tiles))
            windows = asks.field("windows").to_pylist()
            open_ = [j for j, ws in enumerate(windows) if any(high[j, 0] >= w["least"] and low[j, 0] <= w["high"] for w in ws)]
            if not open_:
                continue
            got = scores(queries[open_], tile)
            names, kinds = asks.field("row").to_numpy(), asks.field("label").to_numpy()
            for s, j in zip(got, open_, strict=True):
                fits = (labels == kinds[j]) == same
                fits &= rows != names[j]
                for w in windows[j]:
                    at = np.flatnonzero(fits & (s >= w["least"]) & (s <= w["high"]))
                    if len(at) > k:  # only what reaches the kth score, ties included
                        at = at[s[at] >= np.partition(s[at], -k)[-k]]
                        at = at[np.lexsort((ids[at], -s[at]))[:k]]
                    out += zip([int(names[j])] * len(at), [w["w"]] * len(at), s[at].tolist(), ids[at].tolist(), strict=True)
        columns = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["row", "w", "score", "vec_id"])


class Index:
    """Inverted lists of rows (vec_id, label, vec)."""

    def __init__(self, rows: DataFrame, max_lists: int = MAX_LISTS, sample_rows: int = SAMPLE_ROWS, tile_rows: int = TILE_ROWS):
        self.spark = rows.sparkSession
        written = cut(rows.withColumn("row", F.monotonically_increasing_id()))
        count, self.dim = written.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
        sample = written.orderBy(F.xxhash64("vec_id", "row")).limit(sample_rows).select("vec").toArrow().column("vec").combine_chunks()
        vectors = _matrix(sample, self.dim)
        centroids = fitted(vectors, max(1, min(max_lists, int(count**0.5)))) if count and self.dim else np.zeros((1, self.dim))
        far = "row long, vec_id long, label long, vec array<bigint>, list int, far double"
        dealt = cut(written.select("row", "vec_id", "label", "vec").mapInArrow(partial(_dealt, centroids=centroids), far))
        self.rows = dealt
        radii, tiles = np.zeros(len(centroids)), np.zeros(len(centroids), np.int64)
        for r in dealt.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect():
            radii[r.list], tiles[r.list] = r.radius, -(-r.n // tile_rows)
        self.lists = Lists(centroids, radii, tiles)
        self.sizes = self.spark.createDataFrame([(i, int(n)) for i, n in enumerate(tiles) if n] or [(0, 1)], "list int, tiles int")
        tiled = dealt.join(F.broadcast(self.sizes), "list").withColumn("tile", F.pmod(F.xxhash64("row"), F.col("tiles")).cast("int"))
        schema = "list int, tile int, rows binary, ids binary, labels binary, vectors binary, radius double"
        dim = self.dim
        self.tiles = cut(tiled.groupBy("list", "tile").applyInArrow(lambda group: _tile(group, dim), schema))

    def search(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """(row, w, rank, score, vec_id): the k best rows for each window of each query.

        queries has row (of the query itself), label, vec and windows, array of (w, low,
        high), whose scores count.  same: rows of the query's label, else of other labels.
        """
        n = queries.count()
        found: DataFrame | None = None
        kth: DataFrame | None = None
        first, size = 0, FIRST_LISTS
        blocks = max(1, -(-n // BLOCK))
        while first < len(self.lists.centroids):
            known = queries if kth is None else queries.join(kth, "row", "left")
            least = lambda w: w["low"] if kth is None else F.greatest(w["low"], F.coalesce(F.element_at("kth", w["w"]), w["low"]))  # noqa: B023, E731
            state = known.select("row", "label", "vec", F.transform("windows", lambda w: F.struct(w["w"].alias("w"), least(w).alias("least"), w["high"].alias("high"))).alias("windows"))
            asks = cut(state.mapInArrow(partial(_asks, lists=self.lists, first=first, last=first + size), _ASKS))
            if asks.isEmpty() and self._closed(state, first + size):
                break
            one = F.struct("row", "label", "vec", "windows")
            block = asks.groupBy("list", F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block")).agg(F.collect_list(one).alias("asks"))
            block = block.join(F.broadcast(self.sizes), "list").select("list", "asks", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
            visits = block.join(self.tiles, ["list", "tile"])
            got = visits.mapInArrow(partial(_visited, lists=self.lists, k=k, same=same), "row long, w int, score long, vec_id long")
            order = Window.partitionBy("row", "w").orderBy(F.desc("score"), "vec_id")
            every = got if found is None else found.drop("rank").union(got)
            found = cut(every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
            full = found.where(F.col("rank") == k)
            kth = full.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("kth"))
            first, size = first + size, size * _STEP
        return found if found is not None else self.spark.createDataFrame([], "row long, w int, score long, vec_id long, rank int")

    def _closed(self, state: DataFrame, first: int) -> bool:
        """Whether no query asks for a list from the `first` on."""
        rest = partial(_asks, lists=self.lists, first=first, last=len(self.lists.centroids))
        return state.mapInArrow(rest, _ASKS).isEmpty()


def hard_negatives(
    rows: DataFrame, anchors: Column, vec_id: str = "vec_id", vector: str = "embedding", label: Column | str = "label",
    positives: int = 5, negatives: int = 5, low: tuple[int, int] = (4, 5), scale: int = 256, max_lists: int = MAX_LISTS, tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    anchors: which rows are anchors, by column vec_id.  For each anchor and each of its
    `positives` best other rows of its label: the `negatives` best rows of other labels that
    score at least low[0] / low[1] of the positive's score and not more than it.
    """
    label = F.col(f"`{label}`") if isinstance(label, str) else label
    index = Index(integers(rows, vec_id, vector, label, scale), max_lists, tile_rows=tile_rows)
    queries = cut(index.rows.where(anchors).select("row", F.col("vec_id").alias("anchor_id"), "label", "vec"))
    one = lambda w, a, b: F.struct(w.cast("int").alias("w"), a.cast("long").alias("low"), b.cast("long").alias("high"))
    any_score = F.array(one(F.lit(1), F.lit(_ENDS[0]), F.lit(_ENDS[1])))
    near = index.search(queries.withColumn("windows", any_score), positives, True)
    # ceil(a p / b) in whole numbers; the product has room in a decimal.
    share = F.col("score").cast("decimal(20,0)") * low[0]
    least = ((share + F.pmod(-share, F.lit(low[1]))) / low[1]).cast("long")
    near = near.select("row", F.col("rank").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), least.alias("low"))
    windows = near.where("low <= positive_score").groupBy("row").agg(F.collect_list(one(F.col("w"), F.col("low"), F.col("positive_score"))).alias("windows"))
    far = index.search(cut(queries.join(windows, "row")), negatives, False)
    out = near.join(far.select("row", "w", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), ["row", "w"])
    return out.join(queries.select("row", "anchor_id"), "row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

