"""Approximate nearest neighbours with a forest of random-projection trees.

Trees are fitted on a bounded sample; a node's plane lies between two random
points of the node, through the median projection.  Every row is put into one
leaf of every tree.  A query walks all trees through one priority queue, ordered
by the smallest margin on the way.  From its FIRST leaves it learns how far its
k-th neighbour is at most; then it goes on through the queue to leaves whose
margin is below REACH of that distance, however few or many these are, so on data
with structure a query sees a small share of the rows.  The rows of all these
leaves are ranked by their exact distances.

Equal vectors are one candidate that carries its smallest ids, as many as a
result can hold, so a vector that a third of all rows share fills no leaf.
Leaves that outgrow a block are cut into blocks, each with all of the leaf's
queries.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

TREES = 4
#: Rows that the trees are fitted on, at most.
SAMPLE = 65_536
LEAF = 512
#: Leaves of a tree, about, so that what a query brings back does not grow with the table.
LEAVES = 64
#: Leaves that a query visits before it knows how far to go, and the share of its k-th distance to which it goes then.
FIRST, REACH = 16, 0.1
BLOCK = 8_192


class Forest:
    """Planes of all trees in one table; a child below zero is leaf -child-1."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, seed: int):
        rng = np.random.default_rng(seed)
        self.planes: list[np.ndarray] = []
        self.offsets: list[float] = []
        self.children: list[list[int]] = []
        self.shares: list[float] = []
        self.roots = [self._grow(sample, np.arange(len(sample)), leaf, rng, len(sample)) for _ in range(trees)]
        self.planes = np.array(self.planes).reshape(-1, sample.shape[1])
        self.offsets = np.array(self.offsets)

    def _grow(self, x: np.ndarray, rows: np.ndarray, leaf: int, rng: np.random.Generator, total: int) -> int:
        if len(rows) > leaf:
            a, b = x[rng.choice(rows, 2, replace=False)]
            plane = (a - b) / (np.linalg.norm(a - b) or 1.0)
            at = x[rows] @ plane
            offset = float(np.median(at))
            right = at > offset
            if 0 < right.sum() < len(rows):
                node = len(self.planes)
                self.planes.append(plane)
                self.offsets.append(offset)
                self.children.append([0, 0])
                self.children[node] = [self._grow(x, rows[~right], leaf, rng, total), self._grow(x, rows[right], leaf, rng, total)]
                return node
        self.shares.append(len(rows) / total)
        return -len(self.shares)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """rows x trees: the leaf of each row in each tree."""
        children = np.array(self.children, np.int64).reshape(-1, 2)
        out = np.empty((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            node = np.full(len(x), root)
            while (live := np.flatnonzero(node >= 0)).size:
                n = node[live]
                right = np.einsum("ij,ij->i", x[live], self.planes[n]) > self.offsets[n]
                node[live] = children[n, right.astype(np.int64)]
            out[:, t] = -node - 1
        return out

    def search(self, q: np.ndarray, radius: float, most: int | None = None) -> list[int]:
        """Leaves in the order of one queue shared by all trees, with margins up to ``radius``, no more than ``most``."""
        margins = self.planes @ q - self.offsets
        queue = [(0.0, root) for root in self.roots]
        heapq.heapify(queue)
        found: list[int] = []
        while queue and queue[0][0] <= radius and (most is None or len(found) < most):
            far, node = heapq.heappop(queue)
            if node < 0:
                found.append(-node - 1)
                continue
            m = float(margins[node])
            near = int(m > 0)
            heapq.heappush(queue, (far, self.children[node][near]))
            heapq.heappush(queue, (max(far, abs(m)), self.children[node][1 - near]))
        return found


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


#: Pairs of a query and a row whose exact distances are taken at once.
PAIRS = 1 << 16


def _distances(queries: np.ndarray, rows: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and exact distance of the nearest ``keep`` rows of each query, nearest first, ties to the earlier row.

    A product of matrices gives distances roughly, from a common centre so that a
    large offset costs no digits.  Whatever may, within the error of these, belong
    to the nearest is measured exactly.
    """
    centre = rows.mean(0)
    q, x = queries - centre, rows - centre
    far_q, far_x = (q * q).sum(1), (x * x).sum(1)
    rough = far_q[:, None] + far_x[None, :] - 2.0 * (q @ x.T)
    at = min(keep, len(rows)) - 1
    error = 8 * (rows.shape[1] + 8) * np.finfo(float).eps * (far_q + far_x.max())
    # the centring itself rounds by a digit of the vectors as they are
    error += 16 * np.finfo(float).eps * (np.abs(queries).max() + np.abs(rows).max()) * np.sqrt(rows.shape[1] * (far_q + far_x.max()))
    owner, row = np.nonzero(rough <= (np.partition(rough, at, axis=1)[:, at] + 2 * error)[:, None])
    far = np.empty(len(owner))
    for low in range(0, len(owner), PAIRS):
        step = rows[row[low : low + PAIRS]] - queries[owner[low : low + PAIRS]]
        far[low : low + PAIRS] = np.sqrt((step * step).sum(1))
    order = np.lexsort((row, far, owner))
    owner, row, far = owner[order], row[order], far[order]
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    return owner[place < keep], row[place < keep], far[place < keep]


def nearest(vectors: DataFrame, queries: DataFrame | None = None, k: int = 10, trees: int = TREES, reach: float = REACH, sample: int = SAMPLE, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query, by Euclidean distance.

    queries: a frame with the ids (``id_col``) that are asked; all of them are
    held against all rows but those with the query's own id.  Null ids, and
    vectors that are null, zero, of another length than most, or hold null or
    non-finite components take no part.  Ties go to the smaller id.  Repeated
    rows count once, an id with several vectors has each of them; other columns
    are not read, whatever their names, and an empty table gives no rows.  All
    rows may be queries: blocks of a leaf meet blocks of its queries.  Sides that
    grow with the table are joined by shuffle, for the driver builds what is broadcast.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & v.isNotNull()
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).select("n").first()
    result = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], result)
    rows = rows.where(F.size("v") == lengths[0])
    # of equal vectors the k + 1 smallest ids; the limit is applied before the shuffle
    few = rows.distinct().withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    distinct = materialise(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "ann-rows")
    n = distinct.count()
    forest = spark.sparkContext.broadcast(_fitted(distinct, n, sample, trees, seed))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = forest.value.leaves(_matrix(batch.column("v")))
                yield pa.record_batch([batch.column("v"), batch.column("ids"), pa.array(list(found), pa.list_(pa.int64()))], names=["v", "ids", "leaf"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors, far = _matrix(batch.column("q")), batch.column("far").to_pylist()
                found = [forest.value.search(q, np.inf, FIRST) for q in vectors]
                if far[0] is not None:  # the k-th distance is known: what is in reach and was not visited
                    found = [sorted(set(forest.value.search(q, reach * d)) - set(seen)) for q, d, seen in zip(vectors, far, found)]
                yield pa.record_batch([batch.column("query"), batch.column("q"), pa.array(found, pa.list_(pa.int64()))], names=["query", "q", "leaf"])

    indexed = distinct.mapInArrow(put, "v array<double>, ids array<long>, leaf array<long>").select("v", "ids", F.explode("leaf").alias("leaf"))
    counts = indexed.groupBy("leaf").count()  # a row per leaf of the forest, whose size the sample bounds
    blocks = counts.select("leaf", F.ceil(F.col("count") / BLOCK).cast("long").alias("blocks"))
    asked = rows if queries is None else rows.join(queries.select(F.col(id_col).cast("long").alias("id")).distinct().hint("merge"), "id", "left_semi")
    asked = asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")).distinct()
    groups = materialise(asked.groupBy("q").agg(F.min("query_id").alias("query")), "ann-queries")
    parts = groups.count() // (64 * BLOCK) + 1
    left = materialise(
        indexed.join(F.broadcast(blocks), "leaf")
        .withColumn("block", F.pmod(F.xxhash64("ids"), "blocks"))
        .groupBy("leaf", "block")
        .agg(F.collect_list("v").alias("vs"), F.collect_list("ids").alias("idss")),
        "ann-leaves",
    )

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q, x = _matrix(batch.column("qs")[i].values), _matrix(batch.column("vs")[i].values)
                names, ids = np.array(batch.column("queries")[i].as_py()), batch.column("idss")[i].as_py()
                by_id = sorted(range(len(ids)), key=lambda j: ids[j][0])
                x, ids = x[by_id], [ids[j] for j in by_id]
                for low in range(0, len(q), 64):
                    owner, at, far = _distances(q[low : low + 64], x, k + 1)
                    yield pa.record_batch([pa.array(names[low : low + 64][owner]), pa.array(far), pa.array([ids[j] for j in at.tolist()], pa.list_(pa.int64()))], names=["query", "score", "ids"])

    def ranked(asking: DataFrame) -> DataFrame:
        walks = asking.mapInArrow(ask, "query long, q array<double>, leaf array<long>").select("query", "q", F.explode("leaf").alias("leaf"))
        # queries are cut into groups as well, so that neither side of a leaf can outgrow a task
        right = walks.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(parts))).groupBy("leaf", "part").agg(F.collect_list("query").alias("queries"), F.collect_list("q").alias("qs"))
        return left.join(right.hint("merge"), "leaf").select("vs", "idss", "queries", "qs").mapInArrow(rank, "query long, score double, ids array<long>")

    def best_of(found: DataFrame) -> DataFrame:
        return (
            found.groupBy("query", F.col("ids")[0].alias("first")).agg(F.min("score").alias("score"), F.first("ids").alias("ids"))
            .withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("score", "first")))
            .where(F.col("r") <= k + 1)
        )

    first = materialise(best_of(ranked(groups.withColumn("far", F.lit(None).cast("double")))).select("query", "score", "ids"), "ann-first")
    # at k + 1 ids, its own among them, a query knows how far it must look; with fewer, at everything
    reached = first.groupBy("query").agg(F.sum(F.size("ids")).alias("ids"), F.max("score").alias("score"))
    reached = reached.select("query", F.when(F.col("ids") > k, F.col("score")).otherwise(float("inf")).alias("far"))
    more = ranked(groups.join(reached.hint("merge"), "query", "left").select("q", "query", F.coalesce("far", F.lit(float("inf"))).alias("far")))
    best = best_of(first.unionByName(more)).groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("near"))
    flat = F.flatten(F.transform("near", lambda x: F.transform(x["ids"], lambda i: F.struct(x["score"].alias("score"), i.alias("vec_id")))))
    own = asked.join(groups.hint("merge"), "q").select("query_id", "query").join(best.hint("merge"), "query")
    top = own.select("query_id", F.slice(F.array_sort(F.filter(flat, lambda x: x["vec_id"] != F.col("query_id"))), 1, k).alias("top"))
    return top.select("query_id", F.posexplode("top").alias("pos", "x")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def _fitted(distinct: DataFrame, n: int, bound: int, trees: int, seed: int) -> Forest:
    """The forest of at most ``bound`` vectors, those with the smallest hashes; one task holds these, the driver gets the planes."""
    few = distinct if n <= bound else distinct.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int((1 << 30) * 0.98 * bound / n)).limit(bound)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_matrix(batch.column("v")) for batch in batches if batch.num_rows]
        if parts:
            fitted = np.concatenate(parts)
            leaf = max(LEAF * len(fitted) // max(n, LEAF), len(fitted) // LEAVES, 1) if n > LEAF else LEAF
            yield pa.record_batch([pa.array([pickle.dumps(Forest(fitted, trees, leaf, seed))], pa.binary())], names=["forest"])

    ordered = few.select("v").repartition(1).sortWithinPartitions(F.xxhash64("v"))
    return pickle.loads(ordered.mapInArrow(fit, "forest binary").first()[0])
