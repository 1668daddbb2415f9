"""Language-model scoring with an Elias-Fano n-gram trie.

Level 1 is the vocabulary: sorted word hashes with exact counts; a word's id is
its rank.  Level 2 holds the successors of every word: monotone pointers lead
from a context to its range, the successors' ids are made monotone by adding the
last value of the range before (so a search is relative to its context), and the
smoothed probabilities are quantised to 8 bits.  All are Elias-Fano sequences in
files of the shared folder that scoring tasks map into memory.

Both levels are cut into shards of bounded size by the context's hash.  A word
so frequent that its successors could outgrow a shard has them spread by the
successor.  Counts are summed per task before they are shuffled, as sorted
packed blocks, and cover all training documents.

P(w | c) = (count(c w) + MU * P(w)) / (count(c) + MU),
P(w) = (count(w) + 0.5) / (N + 0.5 * (V + 1)); the half of one unseen word is
shared by all, so both sum to 1 over known words and "unknown".
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, materialise, mix64, scratch, word_hashes
from .elias_fano import EliasFano, load, save

MU = 1000.0
END = xxhash.xxh3_64_intdigest(b"\n end")  # no word holds a newline
START = xxhash.xxh3_64_intdigest(b"\n start")
#: Tokens for each shard, on average, and the count above which a context is spread over shards.
SHARD_TOKENS = 1 << 22
#: Tokens that a task gathers before it sends counts on.
FLUSH = 1 << 22
ID_BITS = U64(32)


def training(doc_id: Column) -> Column:
    """Documents to learn from: crc32 of the id as text, modulo 5, is not 1 (a null id counts as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 != 1


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a column, each text closed by END; number of tokens of each text."""
    words, counts = word_hashes(column.to_pylist(), lower=True)
    return np.insert(words, np.cumsum(counts), U64(END)), counts + 1


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def out() -> pa.RecordBatch:
        keys, counts = _summed(held)
        return pa.record_batch([pa.array(keys.view(np.int64)), pa.array(counts)], names=["h", "c"])

    for batch in batches:
        for low in range(0, batch.num_rows, 2000):
            tokens, _ = _tokens(batch.slice(low, 2000).column(0))
            held.append(np.unique(tokens, return_counts=True))
            size += len(held[-1][0])
            if size > FLUSH:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    if not len(keys):
        return keys, counts
    starts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
    return keys[starts], np.add.reduceat(counts, starts)


def _pack(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Differences and counts by byte planes: most planes are zeros, which the shuffle's compression removes."""
    steps = np.diff(keys, prepend=U64(0))
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes(), counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps = np.ascontiguousarray(np.frombuffer(keys, np.uint8).reshape(8, -1).T).view("<u8").ravel()
    return np.cumsum(steps, dtype=U64), np.ascontiguousarray(np.frombuffer(counts, np.uint8).reshape(4, -1).T).view("<u4").ravel()


class Model:
    """The trie's files and totals; lookups load shards as they are needed."""

    def __init__(self, folder: str, bits: int, bases: list[int], tokens: int, words: int, start_count: int):
        self.folder, self.bits, self.bases = folder, bits, np.array(bases, np.int64)
        self.tokens, self.words, self.start_count = tokens, words, start_count

    def shard(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> U64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)

    def vocabulary(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id (-1: unknown) and count of sorted distinct hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        cuts = np.searchsorted(self.shard(hashes), np.arange((1 << self.bits) + 1))
        for s in range(1 << self.bits):
            a, b = cuts[s], cuts[s + 1]
            if a < b and (got := load(self.folder, f"words-{s}")) is not None:
                at = np.minimum(np.searchsorted(got["h"], hashes[a:b]), len(got["h"]) - 1)
                same = got["h"][at] == hashes[a:b]
                ids[a:b] = np.where(same, at + self.bases[s], -1)
                counts[a:b] = np.where(same, got["c"][at], 0)
        return ids, counts

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.tokens + 0.5 * (self.words + 1))

    def home(self, context: np.ndarray, count: np.ndarray, shard: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The shard of a pair: the context's, or for frequent contexts one that depends on the successor too."""
        spread = (mix64(context.astype(U64) ^ mix64(word.astype(U64))) >> U64(64 - self.bits)).astype(np.int64) if self.bits else shard
        return np.where(count > SHARD_TOKENS, spread, shard)

    def pairs(self, tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each token: ids of context and word, counts of both, the pair's shard."""
        distinct, back = np.unique(tokens, return_inverse=True)
        ids, freq = self.vocabulary(distinct)
        word, c_word, shard = ids[back], freq[back], self.shard(distinct)[back]
        context, c_context, c_shard = np.roll(word, 1), np.roll(c_word, 1), np.roll(shard, 1)
        first = np.concatenate(([0], np.cumsum(counts)[:-1]))
        context[first], c_context[first], c_shard[first] = self.words, self.start_count, int(self.shard(np.array([START], U64))[0])
        return context, word, c_context, c_word, self.home(context, c_context, c_shard, word)


def _pairs_task(model: Model):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            by_shard: dict[int, list] = {}
            for keys, shards in held:
                order = np.argsort(shards, kind="stable")
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(shards[order])) + 1, [len(order)]))
                for a, b in zip(cuts[:-1], cuts[1:]):
                    by_shard.setdefault(int(shards[order[a]]), []).append(keys[order[a:b]])
            for s, parts in by_shard.items():
                keys, counts = np.unique(np.concatenate(parts), return_counts=True)
                k, c = _pack(keys, counts)
                yield pa.record_batch([pa.array([s], pa.int32()), pa.array([k], pa.binary()), pa.array([c], pa.binary())], names=["shard", "k", "c"])

        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                tokens, counts = _tokens(batch.slice(low, 2000).column(0))
                if len(tokens):
                    context, word, _, _, home = model.pairs(tokens, counts)
                    held.append(((context.astype(U64) << ID_BITS) | word.astype(U64), home))
                    size += len(tokens)
                if size > FLUSH:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    return task


def _level_task(model: Model):
    """All counts of one shard -> its file of level 2."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        held = [_unpack(k, c) for k, c in zip(table.column("k").to_pylist(), table.column("c").to_pylist())]
        keys, counts = _summed(held)
        context, word = (keys >> ID_BITS).astype(np.int64), (keys & U64(0xFFFFFFFF)).astype(np.int64)
        starts = np.concatenate(([0], np.flatnonzero(np.diff(context)) + 1))
        own = context[starts]
        ends = np.concatenate((starts[1:], [len(keys)])) - 1
        # each range goes on from the last value of the range before
        bases = np.concatenate(([0], np.cumsum(word[ends] + 1)[:-1]))
        values = word + 1 + np.repeat(bases, ends - starts + 1)
        freq = _counts_of(model, np.concatenate((own, word)))
        c_context, c_word = np.repeat(freq[: len(own)], ends - starts + 1), freq[len(own) :]
        logs = np.log10((counts + MU * model.unigram(c_word)) / (c_context + MU))
        low, high = float(logs.min()), float(logs.max())
        step = max((high - low) / 255, 1e-12)
        codes = np.round((logs - low) / step).astype(np.uint8)
        arrays = EliasFano.encode(own).arrays("context") | EliasFano.encode(np.concatenate((starts, [len(keys)]))).arrays("pointer") | EliasFano.encode(values).arrays("successor")
        save(model.folder, f"pairs-{shard}", arrays | {"codes": codes, "scale": np.array([low, step])})
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(keys)], pa.int64())})

    return build


def _counts_of(model: Model, ids: np.ndarray) -> np.ndarray:
    """Counts by id; the start symbol's id is the number of words."""
    distinct, back = np.unique(ids, return_inverse=True)
    out = np.full(len(distinct), model.start_count, np.int64)
    shard = np.searchsorted(model.bases, distinct, side="right") - 1
    for s in np.unique(shard):
        on = (shard == s) & (distinct < model.words)
        if on.any():
            out[on] = load(model.folder, f"words-{s}")["c"][distinct[on] - model.bases[s]]
    return out[back]


def pair_logs(model: Model, context: np.ndarray, word: np.ndarray, home: np.ndarray) -> np.ndarray:
    """log10 P(word | context) of stored pairs, NaN where the pair was not seen."""
    out = np.full(len(context), np.nan)
    order = np.argsort(home, kind="stable")
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(home[order])) + 1, [len(order)]))
    for a, b in zip(cuts[:-1], cuts[1:]):
        on = order[a:b]
        if not len(on) or (got := load(model.folder, f"pairs-{home[on[0]]}")) is None:
            continue
        contexts, pointer, successor = (EliasFano.of(got, x) for x in ("context", "pointer", "successor"))
        where = contexts.find(context[on].astype(U64))
        on, where = on[where >= 0], where[where >= 0]
        start, end = pointer.access(where).astype(np.int64), pointer.access(where + 1).astype(np.int64)
        base = np.where(start > 0, successor.access(np.maximum(start - 1, 0)), U64(0))
        at = successor.find(base + word[on].astype(U64) + U64(1))
        hit = (at >= start) & (at < end)
        out[on[hit]] = got["scale"][0] + got["scale"][1] * got["codes"][at[hit]]
    return out


def _score_task(model: Model):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                tokens, counts = _tokens(part.column(2))
                if not len(tokens):
                    continue
                context, word, c_context, c_word, home = model.pairs(tokens, counts)
                p = model.unigram(c_word)
                logs = np.log10(MU * p / (c_context + MU))
                asked = np.flatnonzero((word >= 0) & (context >= 0))
                keys, first, back = np.unique((context[asked].astype(U64) << ID_BITS) | word[asked].astype(U64), return_index=True, return_inverse=True)
                at = asked[first]
                found = pair_logs(model, context[at], word[at], home[at])[back]
                logs[asked] = np.where(np.isnan(found), logs[asked], found)
                starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
                cols = (counts, np.add.reduceat((c_word > 0).astype(np.int64), starts), np.add.reduceat(np.log10(p), starts), np.add.reduceat(logs, starts))
                yield pa.record_batch([part.column(0), part.column(1), *map(pa.array, cols)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return task


def train(texts: DataFrame) -> Model:
    """Build the trie from the column ``text`` (binary) of all rows."""
    spark = texts.sparkSession
    folder = scratch(spark, "lm")
    counted = materialise(texts.select("text").mapInArrow(_count_task, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "lm-words")
    tokens, words = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    if words >= 1 << 32:
        raise ValueError("more than 2^32 distinct words")
    # every text has one END
    end = counted.where(F.col("h") == F.lit(END - (1 << 64) if END >> 63 else END)).select("c").first()
    bits = max(0, (int(tokens) // SHARD_TOKENS).bit_length())
    shard = F.shiftrightunsigned("h", 64 - bits).cast("int") if bits else F.lit(0)

    def words_file(key: tuple, table: pa.Table) -> pa.Table:
        h = table.column("h").to_numpy().view(U64)
        order = np.argsort(h)
        save(folder, f"words-{key[0].as_py()}", {"h": h[order], "c": table.column("c").to_numpy()[order]})
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([len(h)], pa.int64())})

    sizes = {r.shard: r.n for r in counted.withColumn("shard", shard).groupBy("shard").applyInArrow(words_file, "shard int, n long").collect()}  # one row per shard
    bases = np.concatenate(([0], np.cumsum([sizes.get(s, 0) for s in range(1 << bits)])[:-1])).tolist()
    model = Model(folder, bits, bases, int(tokens), int(words), int(end[0]) if end else 0)
    blocks = texts.select("text").mapInArrow(_pairs_task(model), "shard int, k binary, c binary")
    materialise(blocks.groupBy("shard").applyInArrow(_level_task(model), "shard int, n long"), "lm-pairs")
    return model


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null text counts as empty: one token, the end.  Without training documents
    all tokens are unknown.  Repeated rows are counted and scored each.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), (~training(F.col(id_col))).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    model = train(texts.where("not held_out"))
    kind = dict(texts.dtypes)["doc_id"]
    scored = texts.mapInArrow(_score_task(model), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(model.tokens).cast("long"))
