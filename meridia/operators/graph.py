"""Connected components and greedy groups of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: Edges of a component that one task scans, at most, and edges that a task scans together.
WHOLE, TOGETHER = 2_000_000, 50_000
#: Edges that a task contracts at once before the rounds.
LOCAL = 500_000


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges of a task -> the same connections as edges to the smallest node, no more than there are nodes."""

    def find(root: dict, v):
        while root[v] != v:
            root[v] = v = root[root[v]]
        return v

    root: dict = {}
    for batch in batches:
        for u, v in zip(batch["u"].tolist(), batch["v"].tolist()):
            root.setdefault(u, u)
            root.setdefault(v, v)
            x, y = find(root, u), find(root, v)
            if x != y:
                root[max(x, y)] = min(x, y)
        if len(root) > LOCAL:
            yield pd.DataFrame([(v, find(root, v)) for v in root if find(root, v) != v], columns=["u", "v"])
            root = {}
    yield pd.DataFrame([(v, find(root, v)) for v in root if find(root, v) != v], columns=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> node, component (its smallest node).

    Tasks contract their own edges first; then stars are contracted in turns, in
    a number of rounds that grows with the logarithm of the longest chain.  Edges
    with a null end are left out.
    """
    kind = edges.schema["a"].dataType.simpleString()
    own = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = written(own.mapInPandas(_forest, f"u {kind}, v {kind}").distinct(), "stars")

    def state() -> tuple:
        return tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    was, is_ = None, state()
    while was != is_:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = written(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
        was, is_ = is_, state()
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def _scan(edges: pa.Table) -> pa.Table:
    """The ascending scan over whole components: every node not yet in a group takes its larger neighbours not yet in one."""
    nodes = pc.unique(pa.chunked_array([*edges["a"].chunks, *edges["b"].chunks]))
    nodes = nodes.take(pc.sort_indices(nodes))
    a, b = (pc.index_in(edges[c], value_set=nodes).to_numpy() for c in ("a", "b"))
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    used, anchors, members = np.zeros(len(nodes), bool), [], []
    starts = np.flatnonzero(np.diff(a, prepend=-1))
    for i, j in zip(starts, [*starts[1:], len(a)]):
        if not used[a[i]]:
            new = np.unique(b[i:j][~used[b[i:j]]])
            used[new] = True
            anchors.append(np.full(len(new), a[i]))
            members.append(new)
    take = lambda codes: nodes.take(pa.array(np.concatenate(codes) if codes else [], pa.int64()))
    return pa.table({"anchor": take(anchors), "member": take(members)})


def _rounds(edges: DataFrame) -> DataFrame:
    """The same groups for components too large for a task.

    A node is an anchor if no smaller neighbour is one; any other node belongs to
    its smallest anchor neighbour.  Each round settles, among undecided nodes, those
    with a settled anchor below them and those without an undecided neighbour below.
    """
    nodes = written(edges.select(F.col("a").alias("v")).union(edges.select(F.col("b").alias("v"))).distinct().withColumn("state", F.lit(0)), "groups")
    while not nodes.where("state = 0").isEmpty():
        below = edges.join(nodes.select(F.col("v").alias("a"), F.col("state").alias("s")), "a").groupBy(F.col("b").alias("v")).agg(F.max((F.col("s") == 1).cast("int")).alias("under"), F.max((F.col("s") == 0).cast("int")).alias("open"))
        step = F.when(F.col("state") != 0, F.col("state")).when(F.coalesce("under", F.lit(0)) == 1, 2).when(F.coalesce("open", F.lit(0)) == 0, 1).otherwise(0)
        nodes = written(nodes.join(below, "v", "left").select("v", step.alias("state")), "groups")
    anchors, members = nodes.where("state = 1").select(F.col("v").alias("a")), nodes.where("state = 2").select(F.col("v").alias("b"))
    return edges.join(anchors, "a").join(members, "b").groupBy(F.col("b").alias("member")).agg(F.min("a").alias("anchor")).select("anchor", "member")


def greedy_groups(edges: DataFrame, whole: int = WHOLE) -> DataFrame:
    """edges(a, b), a < b -> anchor, member: who an ascending scan would put into whose group.

    Components are found first and scanned whole, many to a task; one of more than
    ``whole`` edges is settled in rounds instead.  The edges are read twice, in the
    order of their files: tasks contract best what lies together.  Repeated edges
    change nothing.
    """
    edges = edges.where("a is not null and b is not null").select("a", "b")
    kind = edges.schema["a"].dataType.simpleString()
    placed = written(edges.join(components(edges).withColumnRenamed("node", "a").hint("merge"), "a"), "edges")
    sizes = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    # at most one in ``whole`` rows is one of these
    giant = written(sizes.where(F.col("n") > whole).select("component"), "giants")
    buckets = placed.count() // TOGETHER + 1
    fit = placed.join(F.broadcast(giant), "component", "left_anti").select("a", "b", F.pmod(F.xxhash64("component"), F.lit(buckets)).alias("bucket"))
    found = fit.groupBy("bucket").applyInArrow(_scan, f"anchor {kind}, member {kind}")
    if giant.isEmpty():
        return found
    return found.unionByName(_rounds(written(placed.join(F.broadcast(giant), "component").select("a", "b"), "edges")))
