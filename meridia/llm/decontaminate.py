"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

A mask is laid over every position of a text; the words under its ones are
hashed, those under its zeros are ignored, so a substituted word spoils few
seeds.  Seeds of benchmark items and documents are joined; a shared seed fixes
the offset of an item in a document, and there item and document are compared
word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: However a fifth of an item's words, rounded down, is chosen to be replaced, one of these masks still fits if the item
#: has 8 words or more: tried for all choices at 8 to 19 words; longer items have ten words in a row with two at most.
MASKS = ("11111", "111011", "11010011")
#: Items with fewer words have masks of their own length.
SHORT = 8
#: Benchmark seeds that may be broadcast; 24 bytes each.  Beyond, the join shuffles.
BROADCAST_SEEDS = 500_000
#: Share of an item's words that must agree at one offset ...
SIMILARITY = 0.8
#: ... or words in one stretch of the overlap that holds at most one substitution in five words.
STRETCH = 13
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def token_hashes(text: Column) -> Column:
    """Hashes of the words in lower case without ASCII punctuation; an empty array for null."""
    bare = F.trim(F.regexp_replace(F.translate(F.lower(text), PUNCTUATION, ""), r"[\x20\x09-\x0D]+", " "))
    words = F.filter(F.split(bare, " "), lambda w: w != "")
    return F.coalesce(F.transform(words, lambda w: F.xxhash64(w)), F.array().cast("array<bigint>"))


def short_masks(n: int) -> tuple[str, ...]:
    """Masks for items of n words, fewer than SHORT: the whole item, or from 5 words on all but any one of its words."""
    return ("1" * n,) if n < 5 else ("1" * (n - 1), *("1" * i + "0" + "1" * (n - 1 - i) for i in range(1, n - 1)))


def seeds(rows: DataFrame, keep: list[str], hashes: str, masks: tuple[str, ...]) -> DataFrame:
    """keep..., pos, seed: a row per mask and position that it fits, made from shifted copies of the array side by side."""
    span = max(map(len, masks))
    # what is shifted past the end is null
    shifted = F.arrays_zip(*(F.slice(hashes, i + 1, F.size(hashes)).alias(f"s{i}") for i in range(span)))
    lines = rows.where(F.size(hashes) >= min(map(len, masks))).select(*keep, F.posexplode(shifted).alias("pos", "s"))

    def seed(mask: str) -> Column:
        fits = F.col(f"s.s{len(mask) - 1}").isNotNull()
        return F.when(fits, F.xxhash64(F.lit(int(mask, 2)), *(F.col(f"s.s{i}") for i, c in enumerate(mask) if c == "1")))

    return lines.select(*keep, "pos", F.explode(F.array(*map(seed, masks))).alias("seed")).where("seed is not null")


def _agreement(part: Column, item: Column, at: Column) -> tuple[Column, Column]:
    """Words of the document's part under an item laid at an offset that agree with it, and the most in one stretch.

    A stretch holds at most one substitution in five words: with 1 for a match and
    -4 for a mismatch it sums to 0 or more.  For every end the best start is the
    first at which the running sum was no higher, so the matches up to the first
    place below each level are kept.
    """
    same = F.zip_with(part, F.slice(item, F.greatest(-at, F.lit(0)) + 1, F.size(part)), lambda a, b: (a == b).cast("int"))
    matched = F.aggregate(same, F.lit(0), lambda a, b: a + b)
    zero = F.lit(0)
    start = F.struct(zero.alias("sum"), zero.alias("seen"), zero.alias("low"), F.array().cast("array<int>").alias("first"), zero.alias("best"))

    def step(s: Column, m: Column) -> Column:
        now, seen = s["sum"] + F.when(m == 1, 1).otherwise(-4), s["seen"] + m
        fresh = F.greatest(s["low"] - now, F.lit(0))
        run = F.when(now >= 0, seen).otherwise(seen - F.coalesce(F.get(s["first"], -now - 1), seen))
        first = F.when(fresh > 0, F.concat(s["first"], F.array_repeat(seen, fresh))).otherwise(s["first"])
        return F.struct(now.alias("sum"), seen.alias("seen"), F.least(s["low"], now).alias("low"), first.alias("first"), F.greatest(s["best"], run).alias("best"))

    longest = F.aggregate(same, start, step, lambda s: s["best"])
    # with fewer words in all no overlap counts
    return matched, F.when((matched >= STRETCH) | (matched >= SIMILARITY * F.size(item)), longest).otherwise(0)


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Confirmed overlaps: doc_id, item_id, position, matched, item_words, similarity, stretch.

    An overlap counts if SIMILARITY of the item's words agree, or STRETCH words in
    one stretch; any such overlap shares a seed, whatever the length of item or
    document, and texts may be very long.  Columns of other names, also of this
    result's, are not read; an empty table on either side gives no rows.  An item without words, and rows with null ids or texts, are never
    reported.  The best offset is kept for each item in each document; repeated
    ids are judged together.
    """
    items = materialise(
        benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), token_hashes(F.col(item_text)).alias("item")), "bench-items"
    )
    n = F.size("item")
    short = sorted(r[0] for r in items.where(n.between(1, SHORT - 1)).select(n).distinct().collect())  # fewer than SHORT rows
    keys = seeds(items.where(n >= SHORT), ["item_id"], "item", MASKS)
    for size in short:
        keys = keys.unionByName(seeds(items.where(n == size), ["item_id"], "item", short_masks(size)))
    keys = materialise(keys.distinct(), "bench-seeds")
    laid = tuple(dict.fromkeys([*MASKS, *(mask for size in short for mask in short_masks(size))]))
    wanted = keys.select(F.col("seed"), F.col("item_id"), F.col("pos").alias("item_pos"))
    few = wanted.count() <= BROADCAST_SEEDS  # and as many items with words at most, each of which has one
    if few:
        wanted = F.broadcast(wanted)
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    hits = materialise(
        seeds(texts.select("doc_id", token_hashes(F.col("text")).alias("doc")), ["doc_id"], "doc", laid)
        .join(wanted, "seed")
        .select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("at"))
        .distinct(),
        "bench-hits",
    )
    # the words of a document that has hits are hashed once; a hit carries only the part under its item on
    found = texts.join(hits.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", token_hashes(F.col("text")).alias("doc"))
    low = F.greatest(-F.col("at"), F.lit(0))
    part = F.slice("doc", F.greatest("at", F.lit(0)) + 1, F.greatest(F.col("item_words") - low, F.lit(0)))
    sizes = items.where(n > 0).select("item_id", n.alias("item_words"))
    laid_on = found.join(hits.join(F.broadcast(sizes) if few else sizes, "item_id"), "doc_id").select("doc_id", "item_id", "at", part.alias("part"))
    matched, stretch = _agreement(F.col("part"), F.col("item"), F.col("at"))
    tried = (
        laid_on.join(items, "item_id")
        .select("doc_id", "item_id", F.greatest("at", F.lit(0)).alias("position"), matched.alias("matched"), F.size("item").alias("item_words"), stretch.alias("stretch"))
        .withColumn("similarity", F.col("matched") / F.col("item_words"))
        .where((F.col("similarity") >= SIMILARITY) | (F.col("stretch") >= STRETCH))
    )
    best = F.max(F.struct("matched", "stretch", (-F.col("position")).alias("p"), "item_words", "similarity")).alias("b")
    return tried.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("b.p")).alias("position"), F.col("b.matched").alias("matched"), F.col("b.item_words").alias("item_words"), F.col("b.similarity").alias("similarity"), F.col("b.stretch").alias("stretch")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **names: str) -> DataFrame:
    """The documents, all columns, without those that overlap an item; rows with null ids stay."""
    leaked = overlaps(docs, benchmark, id_col, **names).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(leaked, id_col, "left_anti").select(*docs.columns)
