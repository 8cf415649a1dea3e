"""What several of the operators share: words, hashes, lineage cuts and Arrow plumbing."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are runs of characters other than ASCII white space.
SPACE_CLASS = r"[\x20\x09-\x0D]"
MASK64 = (1 << 64) - 1
#: Any odd number with well mixed bits: the base of the rolling hashes, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def words_of(text: str | None) -> list[bytes]:
    """bytes.split() splits at exactly the ASCII white space of SPACE_CLASS."""
    return (text or "").encode("utf-8", "surrogatepass").split()


class WordTable(dict):
    """Word -> value, filled on demand. Two generations of at most `most` entries bound its memory: when the young one is
    full it becomes the old one, from which words still in use come back.
    """

    def __init__(self, make: Callable[[bytes], object], most: int = 200_000) -> None:
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, word: bytes):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        if len(self) >= self.most:
            self.old.clear()
            self.old.update(self)
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


def word_hashes(seed: int, most: int = 200_000) -> WordTable:
    return WordTable(lambda w: xxhash.xxh3_64_intdigest(w, seed), most)


class Powers:
    """Powers of the rolling base and of its inverse, grown as longer texts come."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            self.up, self.down = (_powers(x, size) for x in (BASE, BASE_INVERSE))
        return self.up[:n], self.down[:n]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


def rolling(hashes: np.ndarray, width: int, powers: Powers) -> np.ndarray:
    """Hashes of all runs of `width` consecutive words (polynomial modulo 2**64 over random word hashes)."""
    n = len(hashes)
    up, down = powers.upto(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * up[:n], out=sums[1:])
    return (sums[width:] - sums[:-width]) * down[: n - width + 1]


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, for orders and cells that must not follow the rolling hash's structure."""
    x = values.astype(np.uint64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def arrow_batches(function: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = function(batch)
            if out is not None and out.num_rows:
                yield out

    return run


def returning_memory(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function over a task's batches; after the last one the worker, which waits for other tasks, gives free memory back to the system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def text_of(text: Column) -> Column:
    """Null texts count as empty."""
    return F.coalesce(text, F.lit(""))


def joined_words(text: Column) -> Column:
    """The words joined by single spaces. Texts that are so already, but for single line ends, take no regular expression."""
    line = F.replace(text, F.lit("\n"), F.lit(" "))
    other = F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for c in "\t\x0b\f\r":
        other = other | F.contains(line, F.lit(c))
    return F.when(other, F.btrim(F.regexp_replace(line, SPACE_CLASS + "+", " "), F.lit(" "))).otherwise(line)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once: a lambda over an array of one."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, combine: Callable[[Column, Column], Column], zero: Column) -> Column:
    """array of what `combine` makes of each prefix of an array, the prefix's last element included.

    Prefixes are folded anew from the last of about root(n) places only: n to the power of 1.5 steps and no growing arrays.
    """
    fold = lambda array: F.aggregate(array, zero, combine)

    def sized(v: Column) -> Column:
        return F.struct(v.alias("v"), F.greatest(F.lit(8), F.ceil(F.sqrt(F.size(v))).cast("int")).alias("step"))

    def blocked(x: Column) -> Column:
        last = F.floor((F.size(x["v"]) - 1) / x["step"]).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda k: fold(F.slice(x["v"], k * x["step"] + 1, x["step"])))
        return F.struct(x["v"].alias("v"), x["step"].alias("step"), blocks.alias("blocks"))

    def preceded(x: Column) -> Column:
        before = F.transform(x["blocks"], lambda _, k: fold(F.slice(x["blocks"], F.lit(1), k)))
        return F.struct(x["v"].alias("v"), x["step"].alias("step"), before.alias("before"))

    def built(x: Column) -> Column:
        def upto(_: Column, i: Column) -> Column:
            k = F.floor(i / x["step"]).cast("int")
            return combine(x["before"][k], fold(F.slice(x["v"], k * x["step"] + 1, i - k * x["step"] + 1)))

        return F.transform(x["v"], upto)

    return bound(bound(bound(bound(values, sized), blocked), preceded), built)
