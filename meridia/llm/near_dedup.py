"""Near-duplicate detection with bottom-k sketches from one hash function.

Every shingle has one hash; a document's sketch is its RETAINED smallest hashes.
Inverted lists of retained values give the candidates, the bottom-k of two
sketches' union estimates their similarity, and what may pass is confirmed on the
full sets.

A list of a frequent word pair would hold most documents.  Sketches are therefore
put in order by the number of documents that retain a value, rarest first, and
only the first values of each are listed: two sketches that have ``t`` values in
common, of ``m`` retained, meet MEETINGS times within the first m - t + MEETINGS of
both.  At similarity
0.8 two sketches of 64 values have 51 in common on average and fewer than LEAST
with a probability of about 1e-6; sketches that hold a whole set of up to
0.8 * RETAINED shingles need 0.8 of it, without exception.  A document with fewer
values in common with all others together is in no list at all.

No list is turned into all its pairs.  Members are first held against two members
of their list: the one that shares most of its values with others (of copies of
one text, that text) and one that differs from list to list.  What is confirmed
is joined to components.  In lists that are not of one component then, those
outside the largest component are held against it and against each other, in
blocks of bounded size and without a row for a pair that fails.  Where both sides
fill more than a block, shingles that only one of the documents has decide first who
can face whom: variants of one text that each have more than a ninth of their
shingles to themselves are not similar to each other.  Short lists hold
mostly documents that share one value by chance; of these, two are compared if
they stand together in more than one.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, join_hot, materialise, mix64, shuffles_dropped, split_hashes

#: Values of a document's sketch, and how many of them two similar documents have in common at least.
RETAINED = 64
LEAST = 34
#: Lists in which two similar documents meet at least.  Between components they meet in one of three ways, as member of
#: the list's main component and other, the reverse, or as two others; so that in one of these they meet twice.
MEETINGS = 4
#: Rows of a list, outside its main component, up to which their pairs of ids take no more room than their sketches.
SHORT = 32
#: Documents on either side of a block in which members of lists are compared, and rows that a task takes together.
GROUP = 512
TOGETHER = 2_048
#: Nodes whose edges a task contracts at once.
HELD = 500_000
#: Bits, at most, of the broadcast map of documents whose sets are needed: 32 MB.
MOST_BITS = 1 << 28


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of so many words; all words as one if there are fewer."""
    n = len(words)
    if n == 0:
        return words
    if n < size:
        size = n
    out = words[: n - size + 1].copy()
    for i in range(1, size):
        out = mix64(out + U64(i)) ^ words[i : n - size + 1 + i]
    return np.unique(mix64(out + U64(size)))


def _sets_of(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    for words in split_hashes(column.to_pylist(), lower=True):
        yield shingle_set(words, size)


def _node(values: np.ndarray) -> int | None:
    """A number for each set, whichever document has it: 64 bits of a hash; none for the empty set."""
    return int.from_bytes(xxhash.xxh3_64_digest(values.astype("<u8").tobytes()), "little", signed=True) if len(values) else None


def _keys_task(size: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                part = batch.slice(low, 2000)
                counts, nodes, kept = [], [], []
                for values in _sets_of(part.column(1), size):
                    counts.append(len(values))
                    nodes.append(_node(values))
                    kept.append(values[:RETAINED].view(np.int64))
                ends = np.concatenate(([0], np.cumsum([len(k) for k in kept]))).astype(np.int32)
                flat = pa.array(np.concatenate(kept))
                yield pa.record_batch([part.column(0), pa.array(counts, pa.int64()), pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["doc_id", "n", "node", "retained"])

    return task


def _bit(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix64(ids.astype(U64)) % U64(bits)).astype(np.int64)


def _bitmap(wanted: DataFrame, most: int = MOST_BITS) -> np.ndarray:
    """A bit for each id, by hash, in at most ``most`` bits: what it lets through without need costs work, not results."""
    n = wanted.count()
    bits = min(most, max(1 << 12, 1 << (16 * n).bit_length()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _bit(batch.column(0).to_numpy(), bits)
            yield pa.record_batch([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(U64)).view(np.int64))], names=["at", "bits"])

    words = wanted.mapInArrow(task, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits >> 6, U64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(U64)
    return out


def _wanted_sets(batches: Iterator[pa.RecordBatch], size: int, bitmap) -> Iterator[list[np.ndarray]]:
    """The sets of documents whose bit is set, some at a time."""
    words = bitmap.value
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = _bit(ids, len(words) << 6)
        batch = batch.filter(pa.array((words[at >> 6] >> (at & 63).astype(U64)) & U64(1) == U64(1)))
        for low in range(0, batch.num_rows, 1000):
            yield list(_sets_of(batch.slice(low, 1000).column(1), size))


def _sets_task(size: int, bitmap):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets in _wanted_sets(batches, size, bitmap):
            yield pa.record_batch([pa.array(map(_node, sets), pa.int64()), pa.array([v.astype("<u8").tobytes() for v in sets], pa.binary())], names=["node", "values"])

    return task


def _shingles_task(size: int, bitmap):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets in _wanted_sets(batches, size, bitmap):
            yield pa.record_batch([pa.array(map(_node, sets), pa.int64()), pa.array([v.view(np.int64) for v in sets], pa.list_(pa.int64()))], names=["node", "shingles"])

    return task


def _forest_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a task -> edges of its nodes to the smallest node they reach in it."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = v = root[root[v]]
        return v

    def roots() -> pa.RecordBatch:
        nodes = [(v, r) for v in root if (r := find(v)) != v]
        return pa.record_batch([pa.array([x[i] for x in nodes], pa.int64()) for i in range(2)], names=["u", "v"])

    for batch in batches:
        for u, v in zip(*(c.to_pylist() for c in batch.columns)):
            root.setdefault(u, u)
            root.setdefault(v, v)
            x, y = find(u), find(v)
            root[max(x, y)] = min(x, y)
        if len(root) > HELD:
            yield roots()
            root.clear()
    yield roots()


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> node, component (its smallest node).

    Tasks contract their own edges, then stars are contracted in turns.  The joins
    shuffle, so that a hub's rows can be split and no round broadcasts.
    """
    own = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    now = materialise(own.mapInArrow(_forest_task, "u long, v long").distinct(), "stars")

    def state(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    was, is_ = None, state(now)
    while was != is_:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = materialise(small.distinct(), "stars")
        was, is_ = is_, state(now)
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def _values(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The values of each row: of sketches as lists, of full sets as bytes."""
    if pa.types.is_binary(column.type):
        return [np.frombuffer(b, "<u8") for b in column.to_pylist()]
    return [x for rows in column.chunks for flat in [rows.values.to_numpy().view(U64)] for x in (flat[a:b] for a, b in itertools.pairwise(rows.offsets.to_pylist()))]


def _ordered(x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value with the positions at which it stands."""
    order = np.argsort(x, kind="stable")
    cuts = np.flatnonzero(np.diff(x[order])) + 1 if len(x) else []
    for at in np.split(order, cuts):
        if len(at):
            yield int(x[at[0]]), at


def _common(index: list[np.ndarray], probes: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """For each probe, how many of its values each index row has."""
    values = np.concatenate(index)
    owner = np.repeat(np.arange(len(index)), [len(x) for x in index])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    for q in probes:
        low, high = np.searchsorted(values, q, "left"), np.searchsorted(values, q, "right")
        runs = high - low
        at = np.repeat(low - np.concatenate(([0], np.cumsum(runs)[:-1])), runs) + np.arange(runs.sum())
        yield np.bincount(owner[at], minlength=len(index))


def _blocks(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Positions of index (side 0) and probe (side 1) rows of each block, and the values of all rows."""
    side = table.column("side").to_numpy()
    values = _values(table.column("values"))
    for _, rows in _ordered(table.column("gid").to_numpy()):
        index, probe = rows[side[rows] == 0], rows[side[rows] == 1]
        if len(index) and len(probe):
            yield index, probe, values


def _in_union(sketches: list[np.ndarray], other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the union of each sketch with the other, how many of its RETAINED smallest values there are, and how many of these both have."""
    wide = max(map(len, sketches))
    pad = np.iinfo(np.uint64).max
    rows = np.full((len(sketches), wide + len(other)), pad, U64)
    for row, sketch in zip(rows, sketches):
        row[: len(sketch)] = sketch
    rows[:, wide:] = other
    rows.sort(axis=1)
    # a value that both have stands twice; it counts at its second place
    again = np.zeros(rows.shape, bool)
    again[:, 1:] = (rows[:, 1:] == rows[:, :-1]) & (rows[:, 1:] != pad)
    place = np.cumsum(~again & (rows != pad), axis=1)
    return np.minimum(place[:, -1], RETAINED), (again & (place <= RETAINED)).sum(1)


def _estimate_task(table: pa.Table) -> pa.Table:
    """Rows with sketches -> those that have a row of another component on the other side of their block that may be similar enough.

    What two documents share of the bottom of their union estimates their
    similarity: at least LEAST of RETAINED values, or all of that share if the
    union is smaller.
    """
    component, keep = table.column("component").to_numpy(), np.zeros(table.num_rows, bool)
    for index, probe, values in _blocks(table):
        sizes = np.array([len(values[i]) for i in index])
        for p, common in zip(probe, _common([values[i] for i in index], (values[p] for p in probe))):
            # what the union's bottom shares, both sketches share; a pair of rows that both stay tells nothing new
            near = np.flatnonzero((common >= LEAST / RETAINED * np.minimum(sizes, len(values[p]))) & (component[index] != component[p]))
            near = near[~keep[index[near]]] if keep[p] else near
            # of the values in common no more can lie above the union's bottom than the union has values there
            whole = sizes[near] + len(values[p]) - common[near]
            sure = common[near] - np.maximum(whole - RETAINED, 0) >= LEAST / RETAINED * np.minimum(whole, RETAINED)
            found, open_ = near[sure], near[~sure]
            if len(open_):
                union, shared = _in_union([values[i] for i in index[open_]], values[p])
                found = np.concatenate((found, open_[shared >= LEAST / RETAINED * union]))
            keep[index[found]] = True
            keep[p] |= len(found) > 0
    return table.select(["gid", "side", "node", "component"]).filter(pa.array(keep))


def _exact_task(num: int, den: int):
    """Rows with full sets -> links between components, no more than join the rows of each block."""

    def task(table: pa.Table) -> pa.Table:
        node, component = table.column("node").to_numpy(), table.column("component").to_numpy()
        links = []
        for index, probe, values in _blocks(table):
            root = {c: c for c in np.concatenate((component[index], component[probe])).tolist()}

            def find(c: int, root: dict = root) -> int:
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            sizes = np.array([len(values[i]) for i in index])
            for p, common in zip(probe, _common([values[i] for i in index], (values[p] for p in probe))):
                for i in index[(den * common >= num * (sizes + len(values[p]) - common)) & (node[index] != node[p])]:
                    x, y = find(int(component[i])), find(int(component[p]))
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        links.append((int(node[i]), int(node[p])))
        return pa.table({"a": pa.array([max(x) for x in links], pa.int64()), "b": pa.array([min(x) for x in links], pa.int64())})

    return task


def _faced(index: DataFrame, probe: DataFrame) -> DataFrame:
    """index, probe (group, node, component) -> gid, side, node, component: each probe and its group's index, in blocks of bounded size on both sides."""
    n = index.groupBy("group").agg(F.ceil(F.count("*") / GROUP).alias("blocks")).join(probe.groupBy("group").agg(F.ceil(F.count("*") / GROUP).alias("parts")), "group")
    own = lambda count: F.pmod(F.xxhash64("node"), F.col(count)).cast("long")
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count).cast("long") - 1))
    left = index.join(n, "group").select("group", "node", "component", own("blocks").alias("block"), every("parts").alias("part"), F.lit(0).alias("side"))
    right = probe.join(n, "group").select("group", "node", "component", every("blocks").alias("block"), own("parts").alias("part"), F.lit(1).alias("side"))
    return left.unionByName(right).select(F.xxhash64("group", "block", "part").alias("gid"), "side", "node", "component")


def _united(lists: DataFrame) -> DataFrame:
    """lists (group, node, component) -> the same with lists that are nearly alike made one, so that few pairs stand in several.

    Lists of which one node is the least by hash are united if that makes no more pairs than they have apart.
    """
    for seed in range(2):
        sizes = lists.groupBy("group").agg(F.min(F.xxhash64("node", F.lit(seed))).alias("sign"), F.count("*").cast("double").alias("n"))
        signed = materialise(lists.join(sizes.select("group", "sign"), "group"), "near-signed")
        whole = signed.select("sign", "node", "component").distinct()
        apart = sizes.groupBy("sign").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))
        alike = whole.groupBy("sign").agg(F.count("*").cast("double").alias("n")).join(apart, "sign").where("n * n <= pairs").select("sign")
        alike = materialise(alike, "near-alike")
        one = whole.join(alike, "sign", "left_semi").withColumnRenamed("sign", "group")
        lists = materialise(one.unionByName(signed.join(alike, "sign", "left_anti").drop("sign")), "near-united")
    return lists


def _reaches(nodes: DataFrame, each: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """nodes (node) -> node, n, reach: of the nodes, those similar to this one have no more than ``reach`` shingles.

    Two sets of n and m shingles are similar if they share num / (num + den) of
    n + m at least, and neither shares what it has to itself.
    """
    sizes = materialise(each.join(nodes, "node").select("node", "n", "doc_id"), "near-sizes")
    bitmap = texts.sparkSession.sparkContext.broadcast(_bitmap(sizes.select("doc_id")))
    sets = texts.where("doc_id is not null").mapInArrow(_shingles_task(words, bitmap), "node long, shingles array<long>").join(nodes, "node", "left_semi")
    own = sets.select("node", F.explode("shingles").alias("value")).groupBy("value").agg(F.min("node").alias("node"), F.max("node").alias("high")).where("node = high")
    alone = own.groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    most = F.expr(f"(n - coalesce(alone, 0)) * {num + den} div {num} - n")
    reaches = materialise(sizes.join(alone, "node", "left").select("node", "n", most.alias("reach")), "near-reaches")
    bitmap.destroy()
    return reaches


def _narrowed(index: DataFrame, probe: DataFrame, own: DataFrame, each: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """index, probe, and own, which faces itself (group, node, component) -> index, probe, without what can't be similar in crowded groups.

    A node reaches far if its reach is no less than its size.  Of two similar nodes one does at least, for
    both sizes are within the other's reach.  So in groups that fill more than a block on both sides only
    those that reach far face all others, and only sizes within reach of the other side stay.
    """
    parts = lambda x: [F.xxhash64(F.lit(x), "group").alias("group"), "node", "component"]
    index, probe, own = index.select(*parts(0)), probe.select(*parts(0)), own.select(*parts(1))
    count = lambda frame, name: frame.groupBy("group").agg(F.count("*").alias(name))
    crowded = count(index, "i").join(count(probe, "p"), "group").where(F.least("i", "p") > GROUP).select("group").unionByName(count(own, "n").where(F.col("n") > GROUP).select("group"))
    crowded = materialise(crowded, "near-crowded")
    index_all, probe_all = index.unionByName(own), probe.unionByName(own)
    if crowded.isEmpty():
        return index_all, probe_all
    within = lambda frame: frame.join(crowded, "group", "left_semi")
    nodes = materialise(within(index_all.unionByName(probe_all)).select("node").distinct(), "near-crowd")
    reaches = _reaches(nodes, each, texts, words, num, den)
    far = F.col("reach") >= F.col("n")
    sides = lambda frame, side, kind: within(frame).join(reaches, "node").select(F.xxhash64("group", F.lit(kind)).alias("group"), "node", "component", "n", "reach", F.lit(side).alias("side"))
    rows = sides(index_all, 0, 0).where(far).unionByName(sides(probe_all, 1, 0)).unionByName(sides(index, 0, 1).where(~far)).unionByName(sides(probe, 1, 1).where(far))
    rows = materialise(rows, "near-sides")
    bounds = rows.groupBy("group", (1 - F.col("side")).alias("side")).agg(F.min("n").alias("least"), F.max("reach").alias("most"))
    rows = materialise(rows.join(bounds, ["group", "side"]).where("n <= most and least <= reach").select("group", "node", "component", "side"), "near-narrowed")
    rest = lambda frame: frame.join(crowded, "group", "left_anti")
    return tuple(rest(frame).unionByName(rows.where(F.col("side") == side).drop("side")) for side, frame in enumerate((index_all, probe_all)))


def _links(faced: DataFrame, sketches: DataFrame, texts: DataFrame, owners: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """faced rows -> a, b: links between components that the full sets confirm, enough to join what is similar.

    Both steps compare the rows of a block where they lie: the sketches leave
    rows that may have a partner, and of those the full sets are fetched, once
    for each block.  No row is made for a pair that is no link.  Small blocks
    are taken together.
    """
    faced = materialise(faced, "near-faced")
    rows = faced.join(sketches, "node").select("gid", "side", "node", "component", "values")
    bucket = F.pmod("gid", F.lit(faced.count() // TOGETHER + 1)).alias("bucket")
    likely = materialise(rows.select(bucket, "*").groupBy("bucket").applyInArrow(_estimate_task, "gid long, side int, node long, component long"), "near-likely")
    bitmap = texts.sparkSession.sparkContext.broadcast(_bitmap(owners.join(likely.select("node").distinct(), "node", "left_semi").select("doc_id")))
    sets = texts.where("doc_id is not null").mapInArrow(_sets_task(words, bitmap), "node long, values binary").dropDuplicates(["node"])
    bucket = F.pmod("gid", F.lit(likely.count() // GROUP + 1)).alias("bucket")
    rows = likely.join(sets, "node").select(bucket, "gid", "side", "node", "component", "values")
    links = materialise(rows.groupBy("bucket").applyInArrow(_exact_task(num, den), "a long, b long").distinct(), "near-links")
    bitmap.destroy()
    return links


def lists_of(nodes: DataFrame, similarity: float) -> DataFrame:
    """nodes (node, n, retained) -> key, node, known: the lists, with the number of the node's values that others retain too."""
    entries = nodes.select("node", "n", F.explode("retained").alias("key"))
    # counted where the rows lie, and not collected before their shuffle: either would write them once more
    common = entries.withColumn("df", F.count("*").over(Window.partitionBy("key"))).where("df > 1").repartition("node")
    m = F.least("n", F.lit(RETAINED))
    least = F.when(F.col("n") <= int(similarity * RETAINED), F.ceil(F.col("n") * F.lit(similarity) - 1e-9)).otherwise(LEAST)
    # no more than RETAINED values for each node; those that no other retains come first and take places, but need no list
    own = common.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("values"))
    places = F.least(m - least + MEETINGS, m) - (m - F.size("values"))
    listed = own.where(places > 0).select("node", F.size("values").alias("known"), F.explode(F.slice("values", F.lit(1), places.cast("int"))).alias("v"))
    return listed.select(F.col("v.key").alias("key"), "node", "known")


def _twice(rows: DataFrame) -> DataFrame:
    """key, node, component -> a, b: nodes of different components that stand together in more than one list."""
    a, b = (rows.select("key", F.col("node").alias(x), F.col("component").alias(f"of_{x}")) for x in "ab")
    return a.join(b, "key").where("a < b and of_a <> of_b").groupBy("a", "b").agg(F.count("*").alias("lists")).where("lists > 1").select("a", "b")


def near_duplicates(docs: DataFrame, words: int = 5, similarity: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Texts are split at ASCII white space after lower-casing A-Z.  Null, empty and
    blank texts have empty sets and are linked with nothing; texts with fewer
    words than a shingle have one shingle.  Equal sets are one node, known by 64
    bits of a hash.  A null id keeps its row, with a null component, and is kept.
    Rows that repeat an id with other texts are one document with several sets:
    what is linked with any of them is linked with the id, in whatever order the
    rows stand; rows of it without words are not.  Other columns are not read; an empty table gives no rows.
    """
    with shuffles_dropped(docs.sparkSession):
        return _near_duplicates(docs, words, similarity, id_col, text_col)


def _near_duplicates(docs: DataFrame, words: int, similarity: tuple[int, int], id_col: str, text_col: str) -> DataFrame:
    num, den = similarity
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    listed = materialise(texts.mapInArrow(_keys_task(words), "doc_id long, n long, node long, retained array<long>"), "near-keys")
    full = listed.where(F.col("doc_id").isNotNull() & F.col("node").isNotNull())
    # the document whose row, and later whose text, stands for a set
    each = materialise(full.groupBy("node").agg(F.min(F.struct("doc_id", "n", "retained")).alias("of")).select("node", "of.*"), "near-each")
    owners = each.select("node", "doc_id")
    shared = materialise(lists_of(each, num / den), "near-shared")
    # one row per list, whatever its length
    hubs = shared.groupBy("key").agg(F.max(F.struct("known", (-F.col("node")).alias("node"))).alias("first"), F.min_by("node", F.xxhash64("node", "key")).alias("h2"), F.count("*").alias("n")).where("n > 1")
    hubs = hubs.select("key", (-F.col("first.node")).alias("h1"), "h2")
    stars = shared.select("key", "node").join(hubs, "key").select("node", F.explode(F.array_distinct(F.array("h1", "h2"))).alias("hub")).where("node <> hub")
    # of the hubs of its lists, each member is held against the one that it meets in most of them
    met = stars.groupBy("node", "hub").agg(F.count("*").alias("lists")).where("lists > 1")
    best = materialise(met.groupBy("node").agg(F.max_by("hub", F.struct("lists", -F.col("hub"))).alias("group")), "near-stars")
    sketches = each.select("node", F.col("retained").alias("values"))
    alone = lambda rows: rows.withColumn("component", F.col("node"))
    links = _links(_faced(alone(best.select("group", F.col("group").alias("node")).distinct()), alone(best.select("group", "node"))), sketches, texts, owners, words, num, den)
    first = materialise(components(links), "near-components")
    # lists whose members are not yet one component, with the component that most of their members have
    labelled = materialise(shared.join(first, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")), "near-labelled")
    main = labelled.groupBy("key", "component").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "component")).alias("main"), F.count("*").alias("k")).where("k > 1")
    others = materialise(labelled.join(main, "key").select("key", "node", "component", F.col("main.component").alias("main")).where("component <> main"), "near-others")
    facing = materialise(others.groupBy(F.col("main").alias("group"), "node", "component").agg(F.count("*").alias("lists")).where("lists > 1").drop("lists"), "near-facing")
    members = labelled.select("node", "component").distinct().join(facing.select(F.col("group").alias("component")).distinct(), "component", "left_semi")
    members = materialise(members.select(F.col("component").alias("group"), "node", "component"), "near-members")
    # two that meet twice as others do so in a long list, where they are compared at once, or twice in short ones
    mark = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in range(2)]
    mixed = others.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("n"), *mark).where("c0 <> c1")
    short = others.join(mixed.where(F.col("n") <= SHORT).select("key"), "key", "left_semi")
    pairs = materialise(_twice(short), "near-pairs")
    paired = lambda of: pairs.select(F.xxhash64("a").alias("group"), F.col(of).alias("node")).distinct().join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # long lists of the same documents, told by two sums of hashes, are one
    mixed = mixed.where(F.col("n") > SHORT).groupBy("n", "x0", "x1").agg(F.min("key").alias("key")).select("key")
    rest = _united(others.join(mixed, "key", "left_semi").select(F.col("key").alias("group"), "node", "component"))
    faced = _faced(*_narrowed(members, facing, rest, each, texts, words, num, den))
    more = _links(faced.unionByName(_faced(paired("a"), paired("b"))), sketches, texts, owners, words, num, den)
    # the sets of an id with several are of one component
    several = full.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("high"), F.count(F.lit(1)).alias("n")).where("b <> high").drop("high")
    of_id = materialise(join_hot(full.select("doc_id", "node"), several, ["doc_id"], listed.count()).select(F.col("node").alias("a"), "b").where("a <> b").distinct(), "near-of-id")
    whole = components(links.unionByName(more).unionByName(of_id))
    named = owners.join(whole, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    ids = materialise(join_hot(named.select("node", "component"), least, ["component"], owners.count()).select("node", "component_id"), "near-ids")
    copies = ids.join(full.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "node")
    in_set = F.col("node").isNotNull() & F.col("doc_id").isNotNull()
    linked = join_hot(listed.where(in_set).select("doc_id", F.col("n").alias("n_shingles"), "node"), copies, ["node"], listed.count())
    rows = linked.select("doc_id", "n_shingles", "component_id").unionByName(listed.where(~in_set).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
