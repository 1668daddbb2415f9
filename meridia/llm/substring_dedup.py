"""Substring deduplication by relative Lempel-Ziv parsing.

The reference of a document is every document with a smaller id.  It is indexed
as blocks whose borders follow from the words alone: of the 39 twelve-word grams
in a 50-word window the one with the smallest hash is the window's anchor, and
neighbouring windows with one anchor are a block.  Equal windows have equal
anchors at equal offsets, so a repeated window lies in blocks with one anchor,
wherever it stands.

A document is parsed against that index.  A block that occurs whole in a smaller
document is a factor as it is.  At a factor's borders, where blocks share an
anchor but differ, the block's windows are looked up one by one.  Runs of found
windows join to the longest factors; all have 50 words or more and become
duplicate spans.

Only anchors and block hashes of all documents are shuffled; windows only where
different blocks share an anchor.  Aggregates keep one minimum per key, so a
passage in a third of all documents never gathers in one task.  A window is known
by two independent 64-bit hashes, of its anchor and of its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Rolling, join_hot, materialise, mix64, split_hashes

WINDOW = 50
GRAM = 12
LOW32 = U64(0xFFFFFFFF)


GRAMS = Rolling(0x9E3779B97F4A7C15)
BLOCKS = Rolling(0xD6E8FEB86659FD93)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size, out = 1, x
    while size * 2 <= width:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def parse_blocks(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchor hash, block hash, first and last window of each block."""
    n = len(hashes)
    prefix = GRAMS.prefix(hashes)
    at = np.arange(n - gram + 1)
    grams = GRAMS.of(prefix, at, at + gram)
    least = sliding_min((grams & ~LOW32) | at.astype(U64), window - gram + 1)
    anchor = (least & LOW32).astype(np.int64)
    cuts = np.flatnonzero(np.diff(anchor)) + 1
    first = np.concatenate(([0], cuts))
    last = np.concatenate((cuts - 1, [len(anchor) - 1]))
    where = anchor[first]
    words = BLOCKS.of(BLOCKS.prefix(mix64(hashes)), first, last + window)
    shape = ((last - first).astype(U64) << U64(32)) | (where - first).astype(U64)
    return grams[where], mix64(words ^ mix64(shape + U64(1))), first, last


def window_hashes(hashes: np.ndarray, at: np.ndarray, window: int = WINDOW) -> np.ndarray:
    return BLOCKS.of(BLOCKS.prefix(mix64(hashes)), at, at + window)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat).cast(kind))


def _blocks_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = np.zeros(0, np.int64)
    for batch in batches:
        for low in range(0, batch.num_rows, 2000):
            part = batch.slice(low, 2000)
            counts, digests, cols = [], [], ([], [], [], [])
            bodies = part.column(1).to_pylist()
            for body, hashes in zip(bodies, split_hashes(bodies)):
                words = (body or b"").split()
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).digest())
                got = (none,) * 4 if len(words) < WINDOW else parse_blocks(hashes)
                for c, x in zip(cols, got):
                    c.append(_signed(x) if x.dtype == U64 else x)
            yield pa.record_batch(
                [part.column(0), part.column(2), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), *(_lists(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32())))],
                names=["doc_id", "tag", "n_words", "digest", "anchor", "block", "first", "last"],
            )


def _windows_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, tag, text, blocks(anchor, first, last) -> the windows of those blocks."""
    for batch in batches:
        for doc, tag, body, blocks in zip(*(c.to_pylist() for c in batch.columns)):
            at = np.concatenate([np.arange(b["first"], b["last"] + 1) for b in blocks])
            anchors = np.concatenate([np.full(b["last"] + 1 - b["first"], b["anchor"], np.int64) for b in blocks])
            yield pa.record_batch(
                [pa.array(anchors), pa.array(_signed(window_hashes(split_hashes([body])[0], at))), pa.array(np.full(len(at), doc, np.int64)), pa.array(np.full(len(at), tag, np.int64)), pa.array(at.astype(np.int32))],
                names=["anchor", "window", "doc_id", "tag", "at"],
            )


def _remove_task(with_text: bool):
    """doc_id, tag, text, found(first, last) -> spans, and on request what is left of the text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _removed(batch, with_text)

    return task


def _removed(batch: pa.RecordBatch, with_text: bool) -> pa.RecordBatch:
    out: tuple[list, ...] = ([], [], [], [], [], [])
    for doc, tag, body, found in zip(*(c.to_pylist() for c in batch.columns)):
        words = (body or b"").split()
        edges = np.zeros(len(words) + 1, np.int64)
        for f in found:
            edges[f["first"]] += 1
            edges[f["last"] + WINDOW] -= 1
        gone = np.cumsum(edges)[:-1] > 0
        turns = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
        kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
        for o, x in zip(out, (doc, tag, int(gone.sum()), hashlib.sha256(kept).hexdigest(), [{"start": int(a), "end": int(b)} for a, b in zip(turns[::2], turns[1::2])], kept.decode("utf-8", "replace") if with_text else None)):
            o.append(x)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string()), pa.array(out[4], spans), pa.array(out[5], pa.string())], names=["doc_id", "tag", "n_removed", "kept_sha256", "spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, spans (word ranges), with kept text on request.

    A word goes if a 50-word window that covers it also starts in a document
    with a smaller id; windows are judged on the input.  Null or empty text has
    no words; texts under 50 words stay whole.  A null id is neither smaller nor
    larger than any, so that document stays whole.  Rows that repeat an id are
    judged one by one and never against each other.
    """
    # the tag tells the texts of an id apart
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(F.col(text_col)).alias("tag"))
    parsed = materialise(
        texts.mapInArrow(_blocks_task, "doc_id long, tag long, n_words long, digest binary, anchor array<long>, block array<long>, first array<int>, last array<int>"),
        "rlz-blocks",
    )
    # whole-document factors first: all but the smallest of equal documents go, and need no further look
    firsts = parsed.where((F.col("n_words") >= WINDOW) & F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    copies = materialise(join_hot(parsed.select("doc_id", "digest"), materialise(firsts, "rlz-firsts"), ["digest"], parsed.count()).where("doc_id > first_id").select("doc_id", "digest").distinct(), "rlz-copies")
    blocks = materialise(
        parsed.where(F.col("doc_id").isNotNull() & (F.size("anchor") > 0))
        .join(copies, ["doc_id", "digest"], "left_anti")
        .select("doc_id", "tag", F.inline(F.arrays_zip("anchor", "block", "first", "last"))),
        "rlz-index",
    )
    total = blocks.count()
    index = materialise(
        blocks.groupBy("anchor").agg(F.min("doc_id").alias("min_id"), (F.min("block") == F.max("block")).alias("same"), F.count("*").alias("n")).where("n > 1"), "rlz-anchors"
    )
    hits = materialise(join_hot(blocks, index, ["anchor"], total).where("not same or doc_id > min_id"), "rlz-hits")
    mixed = hits.where("not same").select("anchor", "block", "doc_id", "tag", "first", "last")
    known = materialise(mixed.groupBy("anchor", "block").agg(F.min("doc_id").alias("own"), F.count("*").alias("n")), "rlz-known")
    judged = materialise(join_hot(mixed, known, ["anchor", "block"], total), "rlz-judged")
    factors = hits.where("same").select("doc_id", "tag", "first", "last").unionByName(judged.where("doc_id > own").select("doc_id", "tag", "first", "last"))
    # borders: blocks that stand nowhere before as a whole; no more per text of a document than it has words
    borders = judged.where("doc_id = own").groupBy("doc_id", "tag").agg(F.collect_list(F.struct("anchor", "first", "last")).alias("blocks"))
    windows = materialise(
        texts.join(borders, ["doc_id", "tag"]).select("doc_id", "tag", "text", "blocks").mapInArrow(_windows_task, "anchor long, window long, doc_id long, tag long, at int"), "rlz-windows"
    )
    seen = windows.groupBy("anchor", "window").agg(F.min("doc_id").alias("own"), F.max("doc_id").alias("other"), F.count("*").alias("n")).where("other > own").drop("other")
    found = join_hot(windows, materialise(seen, "rlz-seen"), ["anchor", "window"], windows.count()).where("doc_id > own").select("doc_id", "tag", F.col("at").alias("first"), F.col("at").alias("last"))
    spans = factors.unionByName(found).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("first", "last")).alias("found"))
    removed = texts.join(spans, ["doc_id", "tag"]).select("doc_id", "tag", "text", "found").mapInArrow(
        _remove_task(with_text), "doc_id long, tag long, n_removed long, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>, kept string"
    )
    removed = (removed if with_text else removed.drop("kept")).dropDuplicates(["doc_id", "tag"])
    base = parsed.select("doc_id", "n_words", "digest", "tag").join(copies.withColumn("copy", F.lit(True)), ["doc_id", "digest"], "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    out = base.join(removed, ["doc_id", "tag"], "left").select(
        "doc_id", "n_words", "tag",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
        F.when(F.col("copy"), whole).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>"))).alias("spans"),
        *([F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept")).alias("kept")] if with_text else []),
    )
    return out.drop("tag")
