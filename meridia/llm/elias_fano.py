"""Elias-Fano sequences over memory-mapped arrays, with lookups for whole arrays of queries."""

from __future__ import annotations

import json
import mmap
from functools import lru_cache

import numpy as np
from pyarrow import fs
from pyspark import TaskContext

from .common import U64

BLOCK = 8  # words of 64 bits between two counts
ONE = U64(1)


def _select(words: np.ndarray, before: np.ndarray, j: np.ndarray, flip: U64) -> np.ndarray:
    """Bit position of the j-th one (from 0) in words ^ flip; before: ones before each block."""
    block = np.searchsorted(before, j, side="right") - 1
    r = (j - before[block]).astype(np.int64)
    at = block * BLOCK
    last = len(words) - 1
    word = words[np.minimum(at, last)] ^ flip
    for _ in range(BLOCK - 1):
        n = np.bitwise_count(word).astype(np.int64)
        on = r >= n
        if not on.any():
            break
        r -= np.where(on, n, 0)
        at = at + on
        word = np.where(on, words[np.minimum(at, last)] ^ flip, word)
    pos = at * 64
    for width in (32, 16, 8, 4, 2, 1):
        n = np.bitwise_count(word & ((ONE << U64(width)) - ONE)).astype(np.int64)
        on = r >= n
        r -= np.where(on, n, 0)
        word = np.where(on, word >> U64(width), word)
        pos = pos + np.where(on, width, 0)
    return pos


class EliasFano:
    """A non-decreasing sequence: high parts as a bit vector in unary, low parts packed."""

    PARTS = ("low", "high", "ones", "zeros")

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.bits, self.low, self.high, self.ones, self.zeros = n, bits, low, high, ones, zeros

    @classmethod
    def encode(cls, values: np.ndarray) -> "EliasFano":
        values = values.astype(U64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * bits // 64 + 2, U64)
        if bits:
            part = values & ((ONE << U64(bits)) - ONE)
            at = np.arange(n, dtype=U64) * U64(bits)
            word, shift = (at >> U64(6)).astype(np.int64), at & U64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + U64(bits) > U64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (U64(64) - shift[over]))
        spots = (values >> U64(bits)) + np.arange(n, dtype=U64)
        size = (int(spots[-1]) if n else 0) // 64 + 2
        size += -size % BLOCK
        high = np.zeros(size, U64)
        np.bitwise_or.at(high, (spots >> U64(6)).astype(np.int64), ONE << (spots & U64(63)))
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high).astype(np.int64).reshape(-1, BLOCK).sum(1))))[:-1]
        return cls(n, bits, low, high, ones, np.arange(len(ones)) * BLOCK * 64 - ones)

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.{p}": getattr(self, p) for p in self.PARTS} | {f"{name}.shape": np.array([self.n, self.bits])}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], name: str) -> "EliasFano":
        n, bits = (int(x) for x in arrays[f"{name}.shape"])
        return cls(n, bits, *(arrays[f"{name}.{p}"] for p in cls.PARTS))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), U64)
        at = i.astype(U64) * U64(self.bits)
        word, shift = (at >> U64(6)).astype(np.int64), at & U64(63)
        second = np.where(shift > 0, self.low[word + 1] << ((U64(64) - shift) & U64(63)), U64(0))
        return ((self.low[word] >> shift) | second) & ((ONE << U64(self.bits)) - ONE)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        spot = _select(self.high, self.ones, i, U64(0))
        return ((spot - i).astype(U64) << U64(self.bits)) | self._low(i)

    def find(self, value: np.ndarray) -> np.ndarray:
        """Index of each value by successor search, -1 where the successor is another value."""
        out = np.full(len(value), -1, np.int64)
        if not self.n:
            return out
        part = (value >> U64(self.bits)).astype(np.int64)
        top = int(self.access(np.array([self.n - 1]))[0])
        live = np.flatnonzero(value <= U64(top))
        part, want = part[live], value[live] & ((ONE << U64(self.bits)) - ONE)
        flip = U64(0xFFFFFFFFFFFFFFFF)
        start = np.where(part > 0, _select(self.high, self.zeros, np.maximum(part - 1, 0), flip) + 1 - part, 0)
        # values with one high part lie side by side, in the order of their low parts
        end = _select(self.high, self.zeros, part, flip) - part
        last = end
        while True:
            on = np.flatnonzero(start < end)
            if not len(on):
                break
            middle = (start[on] + end[on]) >> 1
            low = self._low(middle) < want[on]
            start[on] = np.where(low, middle + 1, start[on])
            end = end.copy()
            end[on] = np.where(low, end[on], middle)
        at = np.flatnonzero(start < last)
        at = at[self._low(start[at]) == want[at]]
        out[live[at]] = start[at]
        return out


def save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: a line of JSON that tells the parts, then the parts at multiples of 8 bytes; put in place by a rename."""
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    at, parts = 0, {}
    for k, a in arrays.items():
        parts[k] = (at, str(a.dtype), len(a))
        at += a.nbytes + -a.nbytes % 8
    head = json.dumps(parts).encode()
    head += b" " * (-(len(head) + 1) % 8) + b"\n"
    task = TaskContext.get()
    part = f"{root}/{name}.{task.taskAttemptId() if task else 0}.part"
    with store.open_output_stream(part, compression=None) as out:
        out.write(head)
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).tobytes() + b"\0" * (-a.nbytes % 8))
    if store.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:
        store.delete_file(f"{root}/{name}")
    store.move(part, f"{root}/{name}")


@lru_cache(maxsize=4096)
def load(folder: str, name: str) -> dict[str, np.ndarray] | None:
    """The parts of a file, memory-mapped where the shared folder is a mounted path, else read; None if there is no file."""
    store, root = fs.FileSystem.from_uri(folder)
    if store.get_file_info(f"{root}/{name}").type == fs.FileType.NotFound:
        return None
    if isinstance(store, fs.LocalFileSystem):
        with open(f"{root}/{name}", "rb") as f:
            data = memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
    else:
        with store.open_input_file(f"{root}/{name}") as f:
            data = memoryview(f.read())
    end = bytes(data[: 1 << 16]).index(b"\n") + 1
    parts = json.loads(bytes(data[:end]))
    return {k: np.frombuffer(data, dtype, n, end + at) for k, (at, dtype, n) in parts.items()}
