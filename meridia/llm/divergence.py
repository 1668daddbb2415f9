"""Audit of how sources differ in their use of terms, with late string materialization.

Tasks count terms and write them, combined, with digest and text.  From there on
only digests of fixed width, read without the text column, are shuffled: for
counts, for document frequencies, and for probabilities.  Minimum and maximum of
the text under one digest show collisions; what collides is split and counted by
digest and text.  Text is joined back for the terms that are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BYTES_LOWER, LETTERS, U64, materialise

#: Documents of a language that a kept term occurs in, and terms that are listed for a source.
LEAST_DOCUMENTS, LISTED = 30, 50
UNIT, PRIOR = 1_000_000_000, 5
#: Characters of text that are taken at once, and terms that a task holds before it writes them.
CHUNK_CHARS, HELD = 1 << 22, 250_000
#: Sources of a language whose probabilities are compared in one block, and cells in one group of blocks.
BLOCK, CELLS = 256, 400_000
#: Buckets of terms of a language, at least, so that one language is not one task.
BUCKETS = 64
#: Rows of the table of groups, about 100 bytes each, that may be broadcast.
BROADCAST_GROUPS = 50_000

# bytes of terms: ASCII letters, and all bytes of other characters
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32


def _terms(texts: list[str]) -> tuple[pa.StringArray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts, one after another: distinct terms, their digests, the term and the text of every occurrence."""
    data = np.frombuffer("\n".join([*texts, ""]).encode(), np.uint8)
    inside = _LETTER[data]
    edges = np.diff(np.concatenate(([False], inside)).astype(np.int8))
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    small = _SMALL[data[inside]]
    offsets = np.concatenate(([0], np.cumsum(last - first))).astype(np.int32)
    found = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.tobytes()), pa.py_buffer(small.tobytes())).dictionary_encode()
    at = found.indices.to_numpy()
    values = found.dictionary
    start = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1)
    prefix = LETTERS.prefix(BYTES_LOWER[np.frombuffer(values.buffers()[2] or b"", np.uint8, start[-1])])
    digests = LETTERS.of(prefix, start[:-1].astype(np.int64), start[1:].astype(np.int64))
    borders = np.cumsum([len(t.encode()) + 1 for t in texts])
    return values, digests, at, np.searchsorted(borders, first, side="right")


def _counted(lang: list[str], source: list[str], texts: list[str], bits: int) -> pa.Table:
    """lang, source, digest, occurrences, documents, term; and a row without a digest for each group."""
    keys = dict.fromkeys(zip(lang, source))
    number = {k: i for i, k in enumerate(keys)}
    group = np.array([number[k] for k in zip(lang, source)])
    values, digests, term, doc = _terms(texts)
    size = max(1, len(values))
    # once per document, then once per group
    cells, times = np.unique(doc * np.int64(size) + term, return_counts=True)
    doc, term = np.divmod(cells, size)
    cells, at = np.unique(group[doc] * np.int64(size) + term, return_inverse=True)
    where, term = np.divmod(cells, size)
    digest = (digests & U64((1 << bits) - 1)).view(np.int64)[term]
    every, none = np.arange(len(keys)), pa.nulls(len(keys), pa.string())
    where = np.concatenate((where, every))
    zero = np.zeros(len(keys), np.int64)
    return pa.table(
        {
            "lang": pa.array([k[0] for k in keys], pa.string()).take(pa.array(where)),
            "source": pa.array([k[1] for k in keys], pa.string()).take(pa.array(where)),
            "digest": pa.chunked_array([pa.array(digest, pa.int64()), none.cast(pa.int64())]),
            "occurrences": np.concatenate((np.bincount(at, times, len(cells)).astype(np.int64), zero)),
            "documents": np.concatenate((np.bincount(at, minlength=len(cells)).astype(np.int64), zero)),
            "term": pa.chunked_array([values.take(pa.array(term)), none]),
        }
    )


def count_terms(docs: DataFrame, bits: int = 64) -> DataFrame:
    """lang, source, digest, occurrences, documents, term: counted in each task, not yet over all of them."""
    keys = ["lang", "source", "digest", "term"]

    def combined(parts: list[pa.Table]) -> pa.Table:
        sums = pa.concat_tables(parts).group_by(keys).aggregate([("occurrences", "sum"), ("documents", "sum")])
        return sums.rename_columns([c.removesuffix("_sum") for c in sums.column_names]).select(parts[0].column_names)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        rows = 0
        for batch in batches:
            lang, source, texts = (batch.column(i).to_pylist() for i in range(3))
            start = size = 0
            for end, text in enumerate(texts, 1):
                size += len(text)
                if size >= CHUNK_CHARS or end == len(texts):
                    parts.append(_counted(lang[start:end], source[start:end], texts[start:end], bits))
                    rows, start, size = rows + len(parts[-1]), end, 0
                    if rows > 4 * HELD:
                        parts = [combined(parts)]
                        rows = len(parts[0])
                        if rows > 2 * HELD:
                            yield from parts.pop().combine_chunks().to_batches(10_000)
                            rows = 0
        if parts:
            yield from combined(parts).combine_chunks().to_batches(10_000)

    empty = F.lit("")
    slim = docs.select(*(F.coalesce(F.col(c), empty).alias(c) for c in ("lang", "source", "text")))
    return slim.mapInArrow(counted, "lang string, source string, digest long, occurrences long, documents long, term string")


def div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * terms)), by long division in steps of 1,000: exact up to totals of 9e15."""
    below = total + PRIOR * terms
    found, rest = div(count + PRIOR, below), (count + PRIOR) % below
    for _ in range(3):
        found, rest = found * 1000 + div(rest * 1000, below), (rest * 1000) % below
    return found + 1


def collisions(counts: DataFrame) -> DataFrame:
    """Digests that stand for more than one term."""
    return counts.where("digest is not null").groupBy("digest").agg(F.min("term").alias("low"), F.max("term").alias("high")).where("low != high").select("digest")


def _kept(counts: DataFrame, least: int) -> DataFrame:
    """lang, source, digest, split, occurrences of terms in at least ``least`` documents of their language.

    ``split`` is the text of terms whose digest collides, else null.  Colliding
    terms only add to a digest, so the digests kept at first hold all kept terms
    and only these are looked at for collisions.
    """

    def summed(rows: DataFrame, *key: str) -> DataFrame:
        by_group = materialise(rows.groupBy("lang", "source", *key).agg(F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents")), "terms-groups")
        enough = by_group.groupBy("lang", *key).agg(F.sum("documents").alias("d")).where(F.col("d") >= least).select("lang", *key)
        return by_group.join(enough, ["lang", *key], "left_semi").drop("documents")

    seen = counts.where("digest is not null")
    kept = materialise(summed(seen, "digest"), "terms-kept")
    double = materialise(collisions(seen.join(kept.select("digest").distinct(), "digest", "left_semi")), "terms-double")
    whole = kept.withColumn("split", F.lit(None).cast("string"))
    if double.isEmpty():
        return whole
    parted = summed(seen.join(double, "digest", "left_semi").withColumn("split", F.col("term")), "digest", "split")
    return materialise(whole.join(double, "digest", "left_anti").unionByName(parted), "terms-parted")


def _distances(cells: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    """lang, a, b, apart: over terms of either source, the sum of |p - q| less that of the two without the term.

    ``cells`` has lang, s (the source's number in its language), digest, split and
    p; ``groups`` has lang, s and zero (p without the term).  Sources are compared
    in blocks of BLOCK, terms in buckets, so no group holds much more than CELLS
    cells; every group has one bare row for each of its sources.
    """
    buckets = max(BUCKETS, cells.count() // CELLS + 1)
    own = F.floor(F.col("s") / BLOCK).cast("int")
    blocks = groups.groupBy("lang").agg(F.max(own).alias("blocks"))
    bare = groups.where("terms > 0").select("lang", "s", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), F.lit(True).alias("bare"), F.lit(0).cast("long").alias("digest"), F.lit(None).cast("string").alias("split"), F.col("zero").alias("p"))
    full = cells.select("lang", "s", F.pmod(F.xxhash64("digest", "split"), F.lit(buckets)).cast("int").alias("bucket"), F.lit(False).alias("bare"), "digest", "split", "p").unionByName(bare)
    # a block meets itself and every other, the lower number first
    dealt = full.join(F.broadcast(blocks) if few else blocks, "lang").withColumn("other", F.explode(F.sequence(F.lit(0), "blocks"))).select(
        "lang", "bucket", F.least(own, "other").alias("low"), F.greatest(own, "other").alias("high"), "s", "bare", "digest", "split", "p"
    )

    def apart(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lang, _, low, high = key
        base = rows[rows["bare"]].sort_values("s")
        sources, zero = base["s"].to_numpy(), base["p"].to_numpy()
        rows = rows[~rows["bare"]]
        term = rows.groupby(["digest", "split"], dropna=False, sort=False).ngroup().to_numpy()
        terms = int(term.max(initial=-1)) + 1
        order = np.argsort(term, kind="stable")
        at, term, p = np.searchsorted(sources, rows["s"].to_numpy())[order], term[order], rows["p"].to_numpy()[order]
        total = -terms * np.abs(zero[:, None] - zero[None, :])
        step = max(1, CELLS // len(sources))
        for first in range(0, terms, step):
            i, j = np.searchsorted(term, (first, first + step))
            dense = np.repeat(zero[:, None], min(step, terms - first), axis=1)
            dense[at[i:j], term[i:j] - first] = p[i:j]
            for k in range(len(sources)):
                total[k] += np.abs(dense - dense[k]).sum(1)
        a, b = np.indices(total.shape).reshape(2, -1)
        mine = sources // BLOCK
        meant = (a != b) & ((low == high) | (mine[a] != mine[b]))
        return pd.DataFrame({"lang": lang, "a": sources[a[meant]], "b": sources[b[meant]], "apart": total.ravel()[meant]})

    parts = dealt.groupBy("lang", "bucket", "low", "high").applyInPandas(apart, "lang string, a int, b int, apart long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("apart").alias("apart"))


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, listed: int = LISTED, bits: int = 64) -> DataFrame:
    """lang, source, part, item, value, rank: how far sources of a language are apart, and by which terms.

    Null text, language and source count as empty; every row is a document, so
    repeated rows and ids count each; other columns are not read.  A group
    without terms still has its pairs; an empty table gives no rows.  Texts may
    have any length.  Part ``term`` ranks by value, then by text, so text is
    joined to all that tie with the last value listed, however many.  Pairs are
    as many as the contract asks for, the square of a language's sources.
    """
    counts = materialise(count_terms(docs, bits), "terms")
    kept = _kept(counts, least)
    sizes = kept.groupBy("lang").agg(F.countDistinct("digest", F.coalesce("split", F.lit(""))).alias("terms"))
    words = kept.groupBy("lang", "source").agg(F.sum("occurrences").alias("total"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = materialise(
        counts.select("lang", "source").distinct().join(words, ["lang", "source"], "left").join(sizes, "lang", "left")
        .select("lang", "source", number.cast("int").alias("s"), F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.coalesce("terms", F.lit(0)).cast("long").alias("terms")),
        "terms-sizes",
    )
    few = groups.count() <= BROADCAST_GROUPS
    small = F.broadcast if few else lambda frame: frame
    zero = F.when(F.col("terms") > 0, probability(F.lit(0).cast("long"), F.col("total"), F.col("terms"))).otherwise(0)
    groups = groups.withColumn("zero", zero)
    cells = materialise(
        kept.join(small(groups), ["lang", "source"]).withColumn("p", probability(F.col("occurrences"), F.col("total"), F.col("terms"))), "terms-cells"
    )

    two = groups.select(F.col("lang").alias("l"), F.col("source").alias("item"), F.col("s").alias("b"), F.col("zero").alias("zero_b"))
    pairs = groups.join(small(two), (F.col("lang") == F.col("l")) & (F.col("s") != F.col("b")))
    far = _distances(cells, groups, few).withColumnsRenamed({"lang": "fl", "a": "fa", "b": "fb"})
    pairs = pairs.join(far, (F.col("lang") == F.col("fl")) & (F.col("s") == F.col("fa")) & (F.col("b") == F.col("fb")), "left")
    value = F.coalesce("apart", F.lit(0)) + F.col("terms") * F.abs(F.col("zero") - F.col("zero_b"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))

    overall = groups.groupBy("lang").agg(F.sum("total").alias("all"))
    by_lang = cells.groupBy("lang", "digest", "split", "terms").agg(F.sum("occurrences").alias("every")).join(small(overall), "lang")
    by_lang = by_lang.select(F.col("lang").alias("ql"), F.col("digest").alias("qd"), F.col("split").alias("qs"), probability(F.col("every"), F.col("all"), F.col("terms")).alias("q"))
    over = cells.join(by_lang, (F.col("lang") == F.col("ql")) & (F.col("digest") == F.col("qd")) & F.col("split").eqNullSafe(F.col("qs"))).where("p > q and occurrences > 0")
    place = Window.partitionBy("lang", "source")
    first = over.select("lang", "source", "digest", "split", (F.col("p") - F.col("q")).alias("value")).withColumn("place", F.rank().over(place.orderBy(F.desc("value")))).where(F.col("place") <= listed)
    first = materialise(first, "terms-first")
    texts = counts.join(first.where("split is null").select("digest").distinct(), "digest", "left_semi").groupBy("digest").agg(F.min("term").alias("term"))
    terms = first.join(texts, "digest", "left").select("lang", "source", F.lit("term").alias("part"), F.coalesce("split", "term").alias("item"), "value")

    ranks = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).cast("int")
    return pairs.unionByName(terms).withColumn("rank", ranks).where((F.col("part") == "pair") | (F.col("rank") <= listed))
