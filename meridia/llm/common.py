"""Helpers shared by the operators: words, hashes and the shared work folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of characters other than space, tab, newline, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"

U64 = np.uint64
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` of the session; only where that is unset and
    driver and executors are one process (tests) a temporary folder is made and set.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="meridia-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that is run inside go when it ends, not when the driver next collects garbage."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def join_hot(rows: DataFrame, keyed: DataFrame, keys: list[str], total: int, share: int = 1_000) -> DataFrame:
    """Inner join with a frame that has one row for each key and, as ``n``, how many of ``total`` rows have it.

    Keys with more than a ``share``-th of the rows can be no more than ``share``;
    they are broadcast, so their rows stay where they are.  The others shuffle.
    """
    hot = keyed.where(F.col("n") > max(1, total // share))
    common = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(keyed.where(F.col("n") <= max(1, total // share)), keys)
    return common.unionByName(rest).drop("n")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit integers."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


_RANDOM = np.random.default_rng(20240601)
#: A random number for each byte; for the second table capitals count as small letters.
BYTES = _RANDOM.integers(0, 1 << 64, 256, dtype=U64)
BYTES_LOWER = BYTES.copy()
BYTES_LOWER[65:91] = BYTES[97:123]
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


class Rolling:
    """Hashes of any range of a sequence from prefix sums of value * base^i modulo 2^64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, U64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 2 * len(self.powers))
            for name, b in (("powers", self.base), ("inverses", self.inverse)):
                steps = np.full(n, b, U64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, U64)
        np.cumsum(values * self.powers[: len(values)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((prefix[end] - prefix[start]) * self.inverses[start])


LETTERS = Rolling(0xC2B2AE3D27D4EB4F)
CHUNK_BYTES = 1 << 19


def word_hashes(texts: list[bytes | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, one after another, and the number of words of each text.

    The words of many texts are hashed together, by rolling hashes over their
    bytes; null has no words.
    """
    parts, counts, at = [], [], 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (end == at or size + len(texts[end] or b"") <= CHUNK_BYTES):
            size += len(texts[end] or b"") + 1
            end += 1
        chunk = [t or b"" for t in texts[at:end]]
        data = np.frombuffer(b"\n".join(chunk) + b"\n", np.uint8)
        edges = np.diff(np.concatenate(([True], SPACE[data])).astype(np.int8))
        first, last = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
        prefix = LETTERS.prefix((BYTES_LOWER if lower else BYTES)[data])
        parts.append(LETTERS.of(prefix, first, last))
        borders = np.cumsum([len(t) + 1 for t in chunk])
        counts.append(np.diff(np.searchsorted(first, borders), prepend=0))
        at = end
    if not parts:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(parts), np.concatenate(counts).astype(np.int64)


def split_hashes(texts: list[bytes | None], lower: bool = False) -> list[np.ndarray]:
    """The hashes of each text by itself."""
    hashes, counts = word_hashes(texts, lower)
    return np.split(hashes, np.cumsum(counts)[:-1]) if len(counts) else []
