"""Substring dedup: words covered by a window of 50 words that starts in an earlier document too are removed.

First pass: each window stands for the least hash of its grams (runs of GRAM words), so neighbouring windows share one
key, and equal windows have equal keys. Each task counts its documents' keys in a count-min sketch; the sketches are
merged by segments, in streams, so that a segment takes the same memory whatever their number. An estimate is never
below the true count, so no repeated window is lost.
Second pass: only runs of windows whose key is estimated to occur twice go on. They are grouped by key and window hash,
128 bits together that stand for the words (the words of a group are not compared once more), and the least document of
each group keeps its window. Copies within a batch are settled before the exchange, which thus carries one row for a
batch and passage; beyond it a key's rows come in the order of ids, and only the distinct windows of one key are held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzgrid.llm.common import Powers, mixed, rolling, text_of, word_hashes, words_of
from quartzgrid.storage import picked

WINDOW, GRAM = 50, 16
#: Two rows of cells, eight or more for each key as far as the texts' bytes tell, between these powers of two. What the
#: driver gets and sends to all is one bit a cell, 64 MB at most. Beyond about 3 * 10**8 distinct keys (some 50 GB of
#: text) the largest sketch fills and lets more windows pass; results stay exact.
LEAST_BITS, MOST_BITS, SEGMENT_BITS = 22, 28, 16
#: A key stands for about so many bytes of text.
KEY_BYTES = 100
#: Words hashed at once, windows in a row at most, keys a task counts before it writes its cells.
CHUNK_WORDS, RUN, TASK_KEYS = 500_000, 64, 4_000_000
SECOND = 0xD6E8FEB86659FD93


def dedup_passages(documents: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False) -> DataFrame:
    """One row per row of `documents`: id, n_words, n_removed, kept_sha256 (of the kept words joined by spaces), and kept_text if `with_text`.

    A word goes if a window of `window` consecutive words that covers it has a word sequence that also starts in a
    document with a smaller id; windows are judged on the input. Words are runs without ASCII white space, unchanged.
    Null and empty texts have no words. Documents with a null id are neither sources nor changed. Rows with equal ids
    don't remove each other's words. Very long texts are taken whole; an empty table gives no rows; other columns are
    not read.
    """
    docs = picked(documents, {"id": id_column, "text": text_column}).select(F.col("id").cast("long").alias("id"), text_of(F.col("text")).alias("text"))
    gram = min(GRAM, window)
    keyed = docs.where("id IS NOT NULL").select("id", F.xxhash64("text").alias("version"), "text")
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sketch = _merged_sketch(keyed, window, gram, min(MOST_BITS, max(LEAST_BITS, (8 * size // KEY_BYTES).bit_length())))
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    runs = keyed.mapInArrow(_estimated_repeated(shared, window, gram), "key long, id long, version long, starts array<int>, hashes binary")
    ranges = runs.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_settled, "id long, version long, start int, n int")
    removed = ranges.groupBy("id", "version").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("counts"))
    joined = docs.withColumn("version", F.xxhash64("text")).join(removed, ["id", "version"], "left").select("id", "text", "starts", "counts")
    schema = "id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return joined.mapInArrow(_kept(window, with_text), schema).withColumnRenamed("id", id_column)


class _Windows:
    """Keys and hashes of the windows of many texts at once."""

    def __init__(self, window: int, gram: int) -> None:
        self.window, self.gram = window, gram
        self.first, self.second = word_hashes(1), word_hashes(2)
        self.powers = Powers()

    def chunks(self, texts: list[str], hashes: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
        """(document, start, key, hash) of all windows, the documents numbered by their place in `texts`."""
        at, words, lengths, owners = 0, [], [], []
        for k, text in enumerate(texts):
            own = words_of(text)
            if len(own) >= self.window:
                words += own
                lengths.append(len(own))
                owners.append(k)
                at += len(own)
            if at >= CHUNK_WORDS:
                yield self._chunk(words, lengths, owners, hashes)
                at, words, lengths, owners = 0, [], [], []
        if words:
            yield self._chunk(words, lengths, owners, hashes)

    def _chunk(self, words: list[bytes], lengths: list[int], owners: list[int], hashes: bool):
        values = np.fromiter(map(self.first.__getitem__, words), np.uint64, len(words))
        least = mixed(rolling(values, self.gram, self.powers))
        span, have = self.window - self.gram + 1, 1
        while have < span:
            step = min(have, span - have)
            least = np.minimum(least[: len(least) - step], least[step:])
            have += step
        ends = np.cumsum(lengths)
        counts = np.array(lengths) - self.window + 1
        begins = ends - np.array(lengths)
        start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        at = np.repeat(begins, counts) + start
        own = None
        if hashes:
            values = np.fromiter(map(self.second.__getitem__, words), np.uint64, len(words))
            own = rolling(values, self.window, self.powers)[at]
        return np.repeat(np.array(owners), counts), start, least[at], own


def _cells(keys: np.ndarray, cell_bits: int) -> list[np.ndarray]:
    shift = np.uint64(64 - cell_bits)
    return [mixed(keys) >> shift, mixed(keys * np.uint64(SECOND)) >> shift]


def _merged_sketch(docs: DataFrame, window: int, gram: int, cell_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bit rows: whether a cell's merged count is two or more."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, waiting, n = _Windows(window, gram), [], 0
        for batch in batches:
            for owner, _, key, _ in windows.chunks(batch["text"].to_pylist(), False):
                first = np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]))
                pairs = np.stack([owner[first].astype(np.uint64), key[first]])
                order = np.lexsort(pairs)
                pairs = pairs[:, order]
                again = (pairs[:, 1:] == pairs[:, :-1]).all(axis=0)
                waiting.append(pairs[1][np.append(True, ~again)])  # once for a document
                n += len(waiting[-1])
                if n >= TASK_KEYS:
                    yield _task_cells(waiting, cell_bits)
                    waiting, n = [], 0
        if n:
            yield _task_cells(waiting, cell_bits)

    merged = docs.mapInArrow(counted, "segment int, once binary, more binary").repartition("segment").sortWithinPartitions("segment").mapInArrow(_merged_segments, "segment int, bits binary")
    segments = 1 << (cell_bits - SEGMENT_BITS)
    bits = np.zeros((2, segments, 1 << SEGMENT_BITS >> 3), np.uint8)
    for row in merged.toLocalIterator():  # at most 2 * segments rows of 8 KB
        bits[row.segment // segments, row.segment % segments] = np.frombuffer(row.bits, np.uint8)
    return bits[0].ravel(), bits[1].ravel()


def _task_cells(keys: list[np.ndarray], cell_bits: int) -> pa.RecordBatch:
    segments, once, more = [], [], []
    n = 1 << (cell_bits - SEGMENT_BITS)
    for row, cells in enumerate(_cells(np.concatenate(keys), cell_bits)):
        cells, counts = np.unique(cells, return_counts=True)
        segment, local, twice = (cells >> np.uint64(SEGMENT_BITS)).astype(np.int64), cells.astype(np.uint16), counts > 1
        bounds = np.searchsorted(segment, np.arange(n + 1))
        for k in np.flatnonzero(np.diff(bounds)):
            part = slice(bounds[k], bounds[k + 1])
            segments.append(row * n + k)
            once.append(local[part][~twice[part]].tobytes())
            more.append(local[part][twice[part]].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(segments, pa.int32()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], names=["segment", "once", "more"])


def _merged_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by segment -> one row a segment, counted up to two in an array of fixed size."""
    segment, counts = None, np.zeros(1 << SEGMENT_BITS, np.uint8)

    def merged() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([np.packbits(counts >= 2).tobytes()], pa.binary())], names=["segment", "bits"])

    for batch in batches:
        for number, once, more in zip(batch["segment"].to_pylist(), batch["once"], batch["more"]):
            if number != segment:
                if segment is not None:
                    yield merged()
                segment = number
                counts[:] = 0
            at = np.frombuffer(once.as_buffer(), np.uint16)
            counts[at] = np.minimum(counts[at] + 1, 2)
            counts[np.frombuffer(more.as_buffer(), np.uint16)] = 2
    if segment is not None:
        yield merged()


def _estimated_repeated(shared, window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, windows = shared.value, _Windows(window, gram)

        def repeated(keys: np.ndarray) -> np.ndarray:
            out = np.ones(len(keys), bool)
            for row, cells in zip(bits, _cells(keys, (8 * len(bits[0])).bit_length() - 1)):
                out &= (row[cells >> np.uint64(3)] >> (7 - (cells & np.uint64(7))).astype(np.uint8)) & 1 == 1
            return out

        for batch in batches:
            ids, versions = (batch[c].to_numpy(zero_copy_only=False) for c in ("id", "version"))
            found: list[tuple[int, int, int, bytes]] = []
            for owner, start, key, own in windows.chunks(batch["text"].to_pylist(), True):
                first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])))
                passing = repeated(key[first])
                stops = np.append(first[1:], len(key))
                for a, b in zip(first[passing].tolist(), stops[passing].tolist()):
                    for c in range(a, b, RUN):
                        d = min(b, c + RUN)
                        found.append((int(key[c]), int(owner[c]), int(start[c]), own[c:d].tobytes()))
            yield _settled_here(found, ids, versions)

    return run


def _settled_here(found: list[tuple[int, int, int, bytes]], ids: np.ndarray, versions: np.ndarray) -> pa.RecordBatch:
    """Equal runs within the batch: later documents are done here, as ranges; the least ones go on, a document's equal runs as one row.

    A text that repeats a few words has one key throughout and few different runs, so it is a few rows however long it is.
    """
    least: dict[tuple[int, bytes], int] = {}
    for key, owner, _, hashes in found:
        i = ids[owner]
        if least.setdefault((key, hashes), i) > i:
            least[key, hashes] = i
    going: dict[tuple[int, int, bytes], list[int]] = {}
    done: dict[int, list[list[int]]] = {}
    for key, owner, start, hashes in found:
        if ids[owner] == least[key, hashes]:
            going.setdefault((key, owner, hashes), []).append(start)
        else:
            ranges, n = done.setdefault(owner, []), len(hashes) // 8
            if ranges and ranges[-1][0] + ranges[-1][1] == start:
                ranges[-1][1] += n
            else:
                ranges.append([start, n])
    keys, owners, starts, data = [], [], [], []
    for (key, owner, hashes), own in going.items():
        keys.append(key)
        owners.append(owner)
        starts.append(own)
        data.append(hashes)
    for owner, ranges in done.items():
        # Anywhere, but not all copies of a text in one place.
        place = (int(versions[owner]) ^ int(ids[owner]) * SECOND) & (1 << 64) - 1
        for start, n in ranges:
            keys.append(place)
            owners.append(owner)
            starts.append([start])
            data.append(b"R" + n.to_bytes(4, "little"))
    at = np.array(owners, dtype=np.int64)
    signed = np.array(keys, dtype=np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(signed), pa.array(ids[at]), pa.array(versions[at]), pa.array(starts, pa.list_(pa.int32())), pa.array(data, pa.binary())], names=["key", "id", "version", "starts", "hashes"])


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and id -> ranges of windows whose sequence starts in a smaller document.

    Of the rows before a batch only the distinct windows of its first key are known, with their least ids.
    """
    known_key, known_own, known_ids = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(np.frombuffer(batch["hashes"].buffers()[1], np.int32)[batch["hashes"].offset : batch["hashes"].offset + batch.num_rows + 1])
        ready = sizes % 8 == 5
        if ready.any():
            part = batch.filter(pa.array(ready))
            counts = pa.array([int.from_bytes(x[1:], "little") for x in part["hashes"].to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([part["id"], part["version"], part["starts"].flatten(), counts], names=["id", "version", "start", "n"])
        if ready.all():
            continue
        part = batch.filter(pa.array(~ready))
        counts = sizes[~ready] // 8
        keys, all_ids = (part[c].to_numpy(zero_copy_only=False) for c in ("key", "id"))
        if keys[0] != known_key:
            known_own, known_ids = known_own[:0], known_ids[:0]
        old = len(known_own)
        key = np.concatenate([np.full(old, keys[0]), np.repeat(keys, counts)])
        ids = np.concatenate([known_ids, np.repeat(all_ids, counts)])
        own = np.concatenate([known_own, np.frombuffer(b"".join(part["hashes"].to_pylist()), np.uint64)])
        order = np.lexsort((ids, own, key))
        fresh = np.append(True, (key[order][1:] != key[order][:-1]) | (own[order][1:] != own[order][:-1]))
        least = ids[order][np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
        repeated = np.zeros(len(own), bool)
        repeated[order] = ids[order] > least
        first = order[fresh & (key[order] == keys[-1])]
        known_key, known_own, known_ids = keys[-1], own[first], ids[first]
        own, repeated = own[old:], repeated[old:]
        row = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
        edge = np.append(True, (row[1:] != row[:-1]) | (repeated[1:] != repeated[:-1]))
        begin = np.flatnonzero(edge & repeated)
        stops = np.append(np.flatnonzero(edge)[1:], len(own))
        length = stops[np.searchsorted(np.flatnonzero(edge), begin)] - begin
        # Each range, at each of its row's starts.
        many = np.diff(part["starts"].offsets.to_numpy()) if part.num_rows else np.zeros(0, np.int64)
        first = np.cumsum(many) - many
        values = part["starts"].flatten().to_numpy(zero_copy_only=False)
        reps = many[row[begin]]
        which = np.repeat(np.arange(len(begin)), reps)
        within = np.arange(len(which)) - np.repeat(np.cumsum(reps) - reps, reps)
        at = row[begin][which]
        starts = values[first[at] + within] + place[begin][which]
        at = pa.array(at)
        yield pa.RecordBatch.from_arrays([part["id"].take(at), part["version"].take(at), pa.array(starts.astype(np.int32)), pa.array(length[which].astype(np.int32))], names=["id", "version", "start", "n"])


def _kept(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, removed, digests, kept = [], [], [], []
            for text, starts, counts in zip(batch["text"].to_pylist(), batch["starts"].to_pylist(), batch["counts"].to_pylist()):
                words = words_of(text)
                totals.append(len(words))
                gone = 0
                if starts:
                    marks = np.zeros(len(words) + 1, np.int64)
                    a = np.array(starts)
                    np.add.at(marks, a, 1)
                    np.add.at(marks, a + np.array(counts) + window - 1, -1)
                    stays = np.cumsum(marks[:-1]) == 0
                    gone = int(len(words) - stays.sum())
                    words = [words[k] for k in np.flatnonzero(stays)]
                removed.append(gone)
                joined = b" ".join(words)
                digests.append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    kept.append(joined.decode("utf-8", "surrogatepass"))
            arrays = [batch["id"], pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["id", "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(kept, pa.string())] if with_text else []), names=names + ["kept_text"] * with_text)

    return run
