"""Mixing sources to target weights by hash-threshold histograms.

Words are summed by source and hash bucket.  From the running sums the bucket is
found in which a source's budget ends; only that bucket's documents are summed
again, by the next bits of the hash, until a cell holds one document.  What is below the threshold is taken; nothing is sorted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, word_count

BITS = 12  # of the hash, for each level of the histogram
LEVELS = 4
#: Sources whose rows of the plan, about 100 bytes each, may be broadcast.  Beyond, joins by source shuffle.
BROADCAST_SOURCES = 50_000


def source_weight(rank: Column) -> Column:
    """Weights 1, 2, 3, repeating, by rank from 1."""
    return ((rank - 1) % 3 + 1).cast("long")


def source_targets(sizes: DataFrame, cap: int = 3) -> DataFrame:
    """source, source_size -> + weight, target.

    Targets share all words by weight and stop at ``cap`` times the source's
    size; the excess goes to the others by weight.  With sources in order of
    cap / weight the level is found from running sums, without a loop.  One row
    per source passes through one task.
    """
    ranked = sizes.withColumn(
        "weight", source_weight(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    )
    order = Window.orderBy(F.col("source_size") * F.lit(1.0) / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    level = ranked.select(
        "*",
        (F.sum("source_size").over(every) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("left_words"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("left_weight"),
    ).withColumn("level", F.col("left_words").cast("double") / F.col("left_weight").cast("double"))
    # the first source, in that order, whose share fits below its cap sets the level for itself and all after it
    fits = F.col("level") * F.col("weight") <= cap * F.col("source_size")
    found = level.withColumn("common", F.min(F.when(fits, F.struct(F.col("source_size") * F.lit(1.0) / F.col("weight"), F.col("level").alias("level")))).over(every)["level"])
    share = F.coalesce(F.col("common") * F.col("weight"), (cap * F.col("source_size")).cast("double"))
    return found.select("source", "source_size", "weight", F.least(share, (cap * F.col("source_size")).cast("double")).alias("target"))


def hash_digits(key: Column) -> Column:
    """48 bits of md5 as a long: the same in any engine that has md5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, BITS), 16, 10).cast("long")


def mix(docs: DataFrame, cap: int = 3, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, source_size, target, taken.

    Null text has size 0, whatever the length of others; a null source is a source
    of its own, last; an empty table gives no rows; other columns are not read,
    whatever their names.  Every document is taken floor(target / source_size)
    times, and those below the source's threshold once more, so no document
    exceeds ``cap`` times its size.  The threshold is on a hash of the id, among
    equal hashes on one of the text, and among equal rows on their number, so
    that also rows of one id are taken up to their source's target; reruns agree,
    for which of equal rows is taken makes no difference.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), hash_digits(F.col(id_col)).alias("h0"), hash_digits(F.col(text_col)).alias("h1"))
    rows = materialise(rows.withColumn("h2", F.monotonically_increasing_id()), "mix-rows").withColumn("h2", F.shiftrightunsigned(F.xxhash64("h2"), 16))
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), cap)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(cap))).otherwise(0)
    plan = materialise(
        targets.withColumn("whole", whole.cast("long")).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")),
        "mix-plan",
    )
    few = plan.count() <= BROADCAST_SOURCES
    small = F.broadcast if few else lambda frame: frame
    # below: words taken under the threshold so far; prefix: the boundary cell's leading bits; e0, e1: its whole hashes so far
    zero = F.lit(0).cast("long")
    edge = plan.select("source", "budget", zero.alias("below"), zero.alias("prefix"), F.lit(None).cast("long").alias("e0"), F.lit(None).cast("long").alias("e1"))
    cuts = []
    for tier, key in enumerate(("h0", "h1", "h2")):
        known = [f"e{i}" for i in range(tier)]
        for level in range(1, LEVELS + 1):
            shift = BITS * (LEVELS - level)
            at = small(edge.select(F.col("source").alias("s"), *known, "prefix", "budget", "below"))
            on = rows.source.eqNullSafe(F.col("s")) & (F.shiftright(rows[key], shift + BITS) == F.col("prefix"))
            for i in range(tier):
                on &= rows[f"h{i}"] == F.col(f"e{i}")
            cells = rows.join(at, on).groupBy("source", *known, "budget", "below", F.shiftright(key, shift).alias("cell")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
            sums = cells.withColumn("upto", F.col("below") + F.sum("words").over(Window.partitionBy("source").orderBy("cell")))
            # the first cell that passes the budget; if none does, the last one
            found = F.struct("cell", (F.col("upto") - F.col("words")).alias("below"), "words", "n")
            edge = materialise(
                sums.groupBy("source", *known, "budget")
                .agg(F.coalesce(F.min(F.when(F.col("upto") > F.col("budget"), found)), F.max(found)).alias("e"))
                .select("source", *known, "budget", F.col("e.below").alias("below"), F.col("e.cell").alias("prefix"), F.col("e.words").alias("words"), F.col("e.n").alias("n")),
                "mix-edge",
            )
        # a cell of one row counts if it brings the sum nearer; what has more is cut by the next hash
        over, under = F.col("below") + F.col("words") - F.col("budget"), F.col("budget") - F.col("below")
        hashes = [*(F.col(f"e{i}") for i in range(tier)), F.col("prefix"), *(F.lit(None).cast("long"),) * (2 - tier)]
        end = F.col("n") <= 1 if tier < 2 else F.lit(True)
        cuts.append(edge.where(end).select("source", *(h.alias(f"c{i}") for i, h in enumerate(hashes)), ((over <= 0) | ((under >= 0) & (over < under))).alias("counts")))
        edge = edge.where(~end).select("source", "budget", "below", zero.alias("prefix"), *known, F.col("prefix").alias(f"e{tier}"))
        if tier == 2 or edge.isEmpty():
            break
    cut = reduce(DataFrame.unionByName, cuts)
    ends = plan.alias("p").join(cut.withColumnRenamed("source", "s"), F.col("p.source").eqNullSafe(F.col("s")), "left").drop("s", "weight", "budget").withColumnRenamed("source", "ps")
    below = F.col("counts")
    for i in (2, 1, 0):  # below the cut, or at it so far; the cell itself if it counts
        own = F.col(f"h{i}")
        below = F.when(F.col(f"c{i}").isNull(), below).otherwise((own < F.col(f"c{i}")) | ((own == F.col(f"c{i}")) & below))
    return rows.join(small(ends), rows.source.eqNullSafe(F.col("ps"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.coalesce(below, F.lit(False)).cast("long"))).alias("taken")
    )
