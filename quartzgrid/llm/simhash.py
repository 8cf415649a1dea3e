"""SimHash near-duplicates: fingerprints, links within a Hamming radius, classes of linked documents.

Pairs come from bands: 64 bits in radius + 3 blocks, of which any two fingerprints within the radius share at least
three; each choice of three blocks is a key, so no link is lost. Among the fingerprints of a key a pivot table (Hamming
distances to many reference fingerprints) discards the pairs whose coordinates differ by more than the radius in any
place, and what survives is verified bit by bit. Links of a key's fingerprints leave as a star, never as all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzgrid.llm.common import text_of
from quartzgrid.llm.components import Labels, components
from quartzgrid.storage import Workspace, cut, picked

SHINGLE_WORDS, RADIUS, SEED, PIVOTS = 3, 3, 42, 16
REFERENCES = np.random.default_rng(20240607).integers(0, 1 << 64, PIVOTS, dtype=np.uint64)
#: Rows of whole key groups that a task links at once, and fingerprints that it compares as a block.
CHUNK, BLOCK = 60_000, 1024
#: Larger groups are linked by enumerating changed bits, in time linear in the group.
ENUMERATE = 40_000


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Majority bits of the XXH64 of the word shingles of the text with A-Z in lower case; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return majority(shingle_hashes(words, shingle_words))


def shingle_hashes(words: list[bytes], shingle_words: int) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - shingle_words + 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    n = len(hashes)
    if not n:
        return 0
    bits = np.unpackbits(hashes.astype("<u8", copy=False).view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    counts = np.add.reduceat(bits, np.arange(0, n, 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, shingle_words: int = SHINGLE_WORDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fp) per row; fp is the fingerprint's bits as a signed long."""
    docs = picked(documents, {"id": id_column, "text": text_column}).select(F.col("id").cast("long").alias("id"), text_of(F.col("text")).alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            known = {t: fingerprint(t, shingle_words) for t in set(texts)}
            values = np.fromiter((known[t] for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(values)], names=["id", "fp"])

    return docs.mapInArrow(hashed, "id long, fp long")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def classes(documents: DataFrame, shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of `documents`: id, fingerprint (16 hex digits) and component_id.

    Fingerprints link at `radius` or fewer differing bits; component_id is the smallest id reachable by links, its own
    included. Texts without words, null ones too, have fingerprint zero, which links like any other. Fewer words than
    a shingle: the whole sequence is hashed. Null ids count for no component_id (null only if all its ids are).
    Repeated rows come back as often as they occur; an empty table gives no rows; other columns are not read.
    """
    marked = cut(fingerprints(documents, shingle_words, id_column, text_column))
    least = marked.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(least.select("fp"), radius))
    members = roots.select(F.col("node").alias("fp"), "root").unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())
    whole = members.join(least, "fp").groupBy("root").agg(F.min("least").alias("component"))
    named = least.join(members.join(whole, "root").select("fp", "component"), "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    # A table of its own, so that the join can split the rows of a fingerprint that a third of them may have.
    named = Workspace(documents.sparkSession, "classes").keep(named, "named")
    return marked.join(named, "fp").select(F.col("id").alias(id_column), as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """distinct(fp) -> edges (a, b) that join exactly the fingerprints that links within `radius` join."""
    keyed = distinct.select("fp", F.explode(F.array(*_keys(F.col("fp"), radius))).alias("key"))
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_linker(radius), "a long, b long")


def blocks_of(radius: int) -> list[tuple[int, int]]:
    """(first bit, width) of radius + 3 blocks."""
    n = radius + 3
    bounds = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:])]


def _keys(fp: Column, radius: int) -> list[Column]:
    keys = []
    for number, chosen in enumerate(combinations(blocks_of(radius), 3)):
        key, width = F.lit(number).cast("long"), 0
        for first, bits in chosen:
            part = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
            key, width = F.shiftleft(key, bits).bitwiseOR(part), width + bits
        keys.append(key)
    return keys


def _linker(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, fps in whole_groups(batches, "key", ("fp",), CHUNK):
            edges = star(keys, fps.view(np.uint64), radius)
            if len(edges):
                signed = edges.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(signed[:, 0]), pa.array(signed[:, 1])], names=["a", "b"])

    return run


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, columns: tuple[str, ...], size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows sorted by a long key -> arrays (key, *columns) that hold whole groups, of about `size` rows or one group; groups of one row are left out."""
    waiting: list[list[np.ndarray]] = []
    n = 0

    def grouped(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, ...]:
        arrays = [np.concatenate(x) for x in zip(*parts)]
        same = arrays[0][1:] == arrays[0][:-1]
        several = np.append(same, False) | np.append(False, same)
        return tuple(x[several] for x in arrays)

    for batch in batches:
        arrays = [batch[c].to_numpy(zero_copy_only=False) for c in (key, *columns)]
        if not len(arrays[0]):
            continue
        if n >= size:
            begin = int(np.searchsorted(arrays[0], waiting[-1][0][-1], side="right"))
            waiting.append([x[:begin] for x in arrays])
            arrays = [x[begin:] for x in arrays]
            if len(arrays[0]):
                yield grouped(waiting)
                waiting, n = [], 0
        if len(arrays[0]):
            waiting.append(arrays)
            n += len(arrays[0])
    if waiting:
        yield grouped(waiting)


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances to the reference fingerprints, a row each."""
    return np.bitwise_count(fps[:, None] ^ REFERENCES[None, :]).astype(np.int8)


def star(keys: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """Edges (fingerprint, least of its component) of the links among the fingerprints that share a key."""
    if not len(fps):
        return np.zeros((0, 2), np.uint64)
    names, node = np.unique(fps, return_inverse=True)
    labels = Labels(len(names))
    begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(begins, len(keys)))
    table = pivot_table(fps)
    large = np.repeat(sizes > 64, sizes)
    place = np.flatnonzero(~large)
    step = 1
    while True:  # pairs of the small groups, by their distance in the order
        left = place[: len(place) - step]
        right = place[step:]
        pairs = keys[left] == keys[right]
        if not pairs.any():
            break
        _verified(left[pairs], right[pairs], fps, table, node, labels, radius)
        step += 1
    for begin, size in zip(begins[sizes > 64], sizes[sizes > 64]):
        if size > ENUMERATE:
            _enumerated(fps[begin : begin + size], node[begin : begin + size], labels, radius)
            continue
        order = begin + np.argsort(table[begin : begin + size, 0], kind="stable")
        first = table[order, 0]
        for k in range(0, size, BLOCK):
            rows = order[k : k + BLOCK]
            # In the order of the first coordinate, later rows beyond the radius in it end the block's range.
            stop = int(np.searchsorted(first, first[min(k + BLOCK, size) - 1] + radius, side="right"))
            columns = order[k:stop]
            close = np.abs(table[rows, 1][:, None] - table[columns, 1][None, :]) <= radius
            close &= np.abs(table[rows, 0][:, None] - table[columns, 0][None, :]) <= radius
            a, b = np.nonzero(close)
            later = a < b
            _verified(rows[a[later]], columns[b[later]], fps, table, node, labels, radius)
    moved = labels.of != np.arange(len(names))
    return np.stack([names[moved], names[labels.of[moved]]], axis=1)


def _verified(a: np.ndarray, b: np.ndarray, fps: np.ndarray, table: np.ndarray, node: np.ndarray, labels: Labels, radius: int) -> None:
    apart = labels.of[node[a]] != labels.of[node[b]]
    a, b = a[apart], b[apart]
    for k in range(0, PIVOTS, 4):
        near = (np.abs(table[a, k : k + 4] - table[b, k : k + 4]) <= radius).all(axis=1)
        a, b = a[near], b[near]
    near = np.bitwise_count(fps[a] ^ fps[b]) <= radius
    labels.join(node[a[near]], node[b[near]])


def _enumerated(fps: np.ndarray, node: np.ndarray, labels: Labels, radius: int) -> None:
    """Links by changed bits: one side changes up to half the radius, the other the rest; both meet at an equal value."""
    free = [k for k in range(64) if len(np.unique((fps >> np.uint64(k)) & np.uint64(1))) == 2]
    masks = [[sum(1 << k for k in c) for n in range(most + 1) for c in combinations(free, n)] for most in (radius // 2, radius - radius // 2)]
    near = np.concatenate([fps ^ np.uint64(m) for m in masks[0]])
    owner = np.tile(node, len(masks[0]))
    order = np.argsort(near, kind="stable")
    near, owner = near[order], owner[order]
    same = near[1:] == near[:-1]
    labels.join(owner[1:][same], owner[:-1][same]) if 2 * (radius // 2) <= radius else None
    for mask in masks[1]:
        probe = fps ^ np.uint64(mask)
        at = np.minimum(np.searchsorted(near, probe), len(near) - 1)
        hit = near[at] == probe
        labels.join(node[hit], owner[at[hit]])
