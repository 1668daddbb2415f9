"""URL filtering: rules on hosts and paths, and a blocked Bloom filter of listed URLs.

The filter has blocks of 512 bits, eight words of 64; a URL sets one bit in each
word of one block.  It is a table of its filled blocks.  Pages that pass it are
possible hits; an exact hash join with the list removes the false positives.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS_IN_BLOCK = 8
BITS_PER_URL = 16
#: Filter blocks that may be broadcast: 64 bytes each, 4 MB in all.
BROADCAST_BLOCKS = 65_536


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to / ? # or end, A-Z lower-cased; '' where there is none."""
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ? # or end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www. or m., path without a closing slash or .html; scheme, query and fragment go."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    return F.concat(host, F.regexp_replace(path_of(url), r"(/|\.html)$", ""))


def first_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest is put outermost
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, F.lit(rule.name)).otherwise(name), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def _place(url: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block of a URL, and the bit in each of the block's words."""
    at = F.pmod(F.xxhash64(url), F.lit(blocks))
    bits = F.xxhash64(url, F.lit(1))
    return at, [F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS_IN_BLOCK)]


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """listed(url) -> block, w0 .. w7: the filled blocks."""
    at, bits = _place(F.col("url"), blocks)
    one = F.lit(1).cast("long")
    return listed.select(at.alias("block"), *(F.call_function("shiftleft", one, b).alias(f"w{i}") for i, b in enumerate(bits))).groupBy("block").agg(
        *(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS_IN_BLOCK))
    )


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, possible, listed.

    listed: canonical URLs in a column ``url`` (nulls and repeats do no harm).
    Pages that fit a rule get its verdict; others are blocked if listed, else
    allowed.  Null URLs and those without ``://`` have empty host and path and
    are allowed.  Other columns of the inputs are not read.  A URL that very many
    pages have is a possible hit only if it looks listed; with up to 131,072
    listed URLs those join by broadcast, beyond that the adaptive join splits it.
    """
    listed = listed.select("url").where("url is not null").distinct()
    blocks = max(16, listed.count() * BITS_PER_URL // 512 + 1)
    table = bloom_blocks(listed, blocks)
    if blocks <= BROADCAST_BLOCKS:
        table = F.broadcast(table)
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canon"))
    at, bits = _place(F.col("canon"), blocks)
    one = F.lit(1).cast("long")
    hit = F.lit(True)
    for i, b in enumerate(bits):
        mask = F.call_function("shiftleft", one, b)
        hit = hit & (F.col(f"w{i}").bitwiseAND(mask) == mask)
    tested = rows.withColumn("block", at).join(table, "block", "left").withColumn("possible", F.coalesce(hit, F.lit(False)))
    tested = tested.drop("block", *(f"w{i}" for i in range(WORDS_IN_BLOCK)))
    # only possible hits go into the exact join; the others stay where they are
    hits, rest = tested.where("possible"), tested.where("not possible")
    exact = listed.select(F.col("url").alias("canon"), F.lit(True).alias("listed"))
    sure = hits.join(F.broadcast(exact) if blocks <= BROADCAST_BLOCKS // BITS_PER_URL else exact, "canon", "left").unionByName(rest.withColumn("listed", F.lit(False)))
    sure = sure.withColumn("listed", F.coalesce("listed", F.lit(False)))
    name, verdict = first_rule(F.col("host"), F.col("path"), rules)
    return sure.select(
        "page_id", "host", "path", name.alias("rule"),
        F.coalesce(verdict, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "possible", "listed",
    )
