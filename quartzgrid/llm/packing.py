"""Packing: documents in their order, cut into sequences by dynamic programming over document and sentence ends.

f(j) is the least cost of the tokens before boundary j when a sequence ends there. The cost of a sequence is its padding
plus the penalty of the cut that ends it: none at a document's end, SENTENCE inside a document, FORCED inside a
sentence. Padding is linear in the start, so the best start among those within a sequence's length is the front of a
monotone queue; sequences of a power of two need no padding and are a few more transitions. All of it is linear in the
number of boundaries.
"""

from __future__ import annotations

import re
import struct
import zlib
from codecs import charmap_decode
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzgrid.llm.common import WordTable, text_of
from quartzgrid.llm.token_counts import LETTERS, UNUSUAL, byte_chars, load_tokenizer
from quartzgrid.storage import picked

#: Penalties, in tokens of padding: for the sequence itself, for a cut at a sentence's end, for one inside a sentence.
SEQUENCE, SENTENCE, FORCED = 1, 6, 48
#: Without a sentence's end for so many tokens, cuts inside the sentence come into question.
LONGEST = 512
#: Tokens that one run of the dynamic programme sees; its last sequence goes on into the next run.
RUN_TOKENS = 1_000_000
#: Characters of the texts whose boundaries are computed at once.
GROUP_CHARS = 200_000
#: Bytes that end a sentence when a word ends in them.
SENTENCE_ENDS = (b".", b"!", b"?", b".\"", b"!\"", b"?\"", b".)", "…".encode(), "。".encode())

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(documents: DataFrame, tokenizer_path: str, end_id: int = 2, length: int = 4096, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if `with_ids`.

    A document is its tokens and then `end_id`; each token lies in exactly one piece, and a sequence's pieces lie in it
    without gaps. Null and empty texts are documents of one token. Null ids stay null; repeated rows are documents of
    their own. A document longer than a sequence is cut at sentence ends, and where a sentence is longer than LONGEST
    tokens, inside it. An empty table gives no rows. Columns other than the two named are not read.

    The tokenizer must drop white space (then the words between ASCII white space are tokenized on their own, each
    distinct one once for a worker). Order is that of the table; each partition is packed on its own and needs no
    shuffle: at most the last sequence of a partition has padding that order doesn't force. Sequences are numbered from
    their partition's number on, so a task that is run again gives the same pieces only if its rows come in the same
    order again, as a table's do.
    """
    docs = picked(documents, {"doc_id": id_column, "text": text_column}).select(F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col("text")).alias("text"))
    return docs.mapInArrow(_packer(tokenizer_path, end_id, length, with_ids), PIECES + (", ids array<int>" if with_ids else ""))


def best_cuts(positions: np.ndarray, penalties: np.ndarray, length: int) -> list[int]:
    """Indices into `positions` (ascending, the first 0) of the ends of the sequences that cost least.

    Gaps between positions are at most `length`. penalties[j] is the cost of a cut at positions[j].
    """
    at, cost = positions.tolist(), penalties.tolist()
    exact, starts = _powers_of_two(positions, length)
    f, back = [0.0] * len(at), [0] * len(at)
    queue, p = deque([0]), 0
    raised = [0.0] * len(at)  # f(i) + at[i]; along the queue it ascends from the front
    for j in range(1, len(at)):
        here = at[j]
        while at[queue[0]] < here - length:
            queue.popleft()
        start = queue[0]
        best = raised[start] + length - here
        while exact[p] == j:
            k = starts[p]
            if f[k] < best:
                best, start = f[k], k
            p += 1
        f[j], back[j] = best + cost[j] + SEQUENCE, start
        raised[j] = value = f[j] + here
        while queue and raised[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    ends, j = [], len(at) - 1
    while j:
        ends.append(j)
        j = back[j]
    return ends[::-1]


def _powers_of_two(positions: np.ndarray, length: int) -> tuple[list[int], list[int]]:
    """Ends and starts of all sequences of a power of two, by ends, the shortest first; after them an end that is none."""
    ends, starts = [], []
    for power in (1 << k for k in range(length.bit_length()) if 1 << k <= length):
        before = positions - power
        k = np.minimum(np.searchsorted(positions, before), len(positions) - 1)
        hits = np.flatnonzero(positions[k] == before)
        ends.append(hits)
        starts.append(k[hits])
    every = np.concatenate(ends)
    order = np.argsort(every, kind="stable")
    return [*every[order].tolist(), -1], np.concatenate(starts)[order].tolist()


def in_powers(start: int, end: int) -> list[int]:
    """Ends of the sequences of powers of two, largest first, that [start, end) falls into."""
    ends = []
    while start < end:
        start += 1 << ((end - start).bit_length() - 1)
        ends.append(start)
    return ends


#: Parts into which the tokenizer cuts a word of these characters: letters, single digits, runs of anything else.
PART = re.compile(f"[{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+")
#: Words that hold others, an apostrophe (contractions are parts of their own) or a special string take the whole tokenizer.
OTHER = re.compile(f"[^\x21-\x26\x28-\x7e{LETTERS}]|İ|<[|]")
#: Words of these letters alone are one part (the lower case of İ is two characters, one no letter).
WORD = re.compile(f"[{LETTERS}]+")
#: Bytes as marks: "!", an apostrophe as itself, anything that is no mark as a space. Two marks side by side are one part;
#: only where there are none can points and commas be set apart beforehand.
MARKS = re.sub(rb"[^\sa-z0-9\x80-\xff']", b"!", re.sub(rb"[\sa-z0-9\x80-\xff]", b" ", bytes(range(256))))


class _Tokens:
    """Ids of words as bytes; after a word that ends a sentence a mark follows that is no id, after a text another one."""

    MARK, END = 0xFFFFFFFF, 0xFFFFFFFE

    def __init__(self, path: str) -> None:
        self.tokenizer = load_tokenizer(path)
        self.cut_up = self.tokenizer.model.tokenize
        self.chars = "".join(c for _, c in sorted(byte_chars().items()))
        self.ids = WordTable(self._ids, 500_000)

    def _ids(self, word: bytes) -> bytes:
        """Letters need only the vocabulary's merges; in it, bytes of ASCII letters stand for themselves. The empty word ends a text."""
        if not word:
            return _as_bytes([self.END])
        if word.isalpha():
            return _as_bytes([x.id for x in self.cut_up(word.lower().decode())])
        text = word.decode("utf-8", "surrogatepass")
        if WORD.fullmatch(text) and "İ" not in text:
            return _as_bytes([x.id for x in self.cut_up(charmap_decode(text.lower().encode(), "strict", self.chars)[0])])
        if OTHER.search(text):
            out = self._encoded(text)
        else:
            parts = PART.findall(text)
            out = self._encoded(text) if len(parts) == 1 else b"".join([self.ids[p.encode()].removesuffix(b"\xff\xff\xff\xff") for p in parts])
        return out + b"\xff\xff\xff\xff" if word.endswith(SENTENCE_ENDS) else out

    def _encoded(self, text: str) -> bytes:
        return _as_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def of(self, text: str, end_id: int, longest: int = LONGEST) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The ids, the token offsets of its boundaries (its end is the last) and their penalties."""
        return next(self.each([text], end_id, longest))

    def each(self, texts: list[str], end_id: int, longest: int = LONGEST) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
        """What of() says of each text; the offsets are those of all texts in a row until the texts are told apart."""
        words: list[bytes] = []
        for text in texts:
            words += lowered_words(text)
            words.append(b"")
        marked = np.frombuffer(b"".join(map(self.ids.__getitem__, words)), "<u4")
        stops, lasts = np.flatnonzero(marked == self.MARK), np.flatnonzero(marked == self.END)
        ids = marked[marked != self.MARK]
        ends = lasts - np.searchsorted(stops, lasts) + 1
        ids[ends - 1] = end_id
        own, text_of_stop = stops - np.arange(len(stops)), np.searchsorted(lasts, stops)
        starts = np.concatenate([[0], ends[:-1]])
        own = own[(own > starts[text_of_stop]) & (own < ends[text_of_stop] - 1)]
        at = np.unique(np.concatenate([own, ends]))
        penalties = np.full(len(at), float(SENTENCE))
        gaps = np.diff(at, prepend=0)
        if gaps.max() > longest:
            more = np.concatenate([np.arange(e - g + longest, e, longest) for e, g in zip(at[gaps > longest], gaps[gaps > longest])])
            at = np.concatenate([at, more])
            order = np.argsort(at, kind="stable")
            at, penalties = at[order], np.append(penalties, np.full(len(more), float(FORCED)))[order]
        to = np.searchsorted(at, ends)
        penalties[to] = 0.0
        data, a = ids.tobytes(), 0
        for start, end, b in zip(starts.tolist(), ends.tolist(), (to + 1).tolist()):
            yield data[4 * start : 4 * end], at[a:b] - start, penalties[a:b]
            a = b


def _as_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def lowered_words(text: str) -> list[bytes]:
    """Words between ASCII white space, and points and commas apart from them where that changes no token.

    The tokenizer lower-cases anyway; ASCII letters are lowered first, so that fewer words are distinct. Not where a
    special string may be: those are told apart by case.
    """
    data = text.encode("utf-8", "surrogatepass")
    if b"<|" in data:
        return data.split()
    data = data.lower()
    if text.isascii() or not UNUSUAL.search(text):
        marks = data.translate(MARKS)
        if b"!!" not in marks and b"'" not in marks:
            data = data.replace(b".", b" . ").replace(b",", b" , ")
    return data.split()


def _groups(texts: list[str]) -> Iterator[list[str]]:
    """The texts in their order, some at a time: up to GROUP_CHARS characters, or one longer text."""
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > GROUP_CHARS:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def _packer(path: str, end_id: int, length: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _Tokens(path)
        packing = _Run(length, with_ids, TaskContext.get().partitionId() << 40)
        for batch in batches:
            ids, at = batch["doc_id"].to_pylist(), 0
            for texts in _groups(batch["text"].to_pylist()):
                for i, found in zip(ids[at : at + len(texts)], tokens.each(texts, end_id, min(LONGEST, length))):
                    packing.add(i, *found)
                    if packing.size >= RUN_TOKENS:
                        yield from packing.flush(last=False)
                at += len(texts)
        yield from packing.flush(last=True)

    return run


class _Run:
    """Documents that wait to be packed. A document's first tokens may have been packed before; `start` says how many."""

    def __init__(self, length: int, with_ids: bool, first: int) -> None:
        self.length, self.with_ids, self.sequence = length, with_ids, first
        self.docs: list[tuple[int | None, bytes, int, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, i: int | None, ids: bytes, at: np.ndarray, penalties: np.ndarray) -> None:
        self.docs.append((i, ids, 0, at, penalties))
        self.size += len(ids) // 4

    def flush(self, last: bool) -> Iterator[pa.RecordBatch]:
        if not self.docs:
            return
        starts = np.cumsum([0] + [len(ids) // 4 - start for _, ids, start, _, _ in self.docs])
        positions = np.concatenate([[0], *(at - start + s for (_, _, start, at, _), s in zip(self.docs, starts))])
        penalties = np.concatenate([[0.0], *(p for *_, p in self.docs)])
        ends = [int(positions[j]) for j in best_cuts(positions, penalties, self.length)]
        if last:
            begin = ends[-2] if len(ends) > 1 else 0
            powers = in_powers(begin, ends[-1])
            if (len(powers) - 1) * (FORCED + SEQUENCE) < self.length - (ends[-1] - begin) and len(powers) > 1:
                ends[-1:] = powers
        elif len(ends) > 1:
            ends.pop()
        rows: list[tuple] = []
        d = begin = 0
        for end in ends:
            at = begin
            while at < end:
                i, ids, start, _, _ = self.docs[d]
                stop = min(end, int(starts[d + 1]))
                a = start + at - int(starts[d])
                piece = ids[4 * a : 4 * (a + stop - at)]
                rows.append((i, a, stop - at, zlib.crc32(piece), len(ids) // 4, self.sequence, at - begin, piece))
                at = stop
                d += at == starts[d + 1]
            begin = end
            self.sequence += 1
        rest = []
        if d < len(self.docs):
            i, ids, start, marks, p = self.docs[d]
            done = start + begin - int(starts[d])
            rest = [(i, ids, done, marks[marks > done], p[marks > done]), *self.docs[d + 1 :]]
        self.docs, self.size = rest, int(starts[-1]) - begin
        columns = list(zip(*rows))
        arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if self.with_ids:
            flat = pa.array(np.frombuffer(b"".join(columns[7]), "<u4").astype(np.int32))
            arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(columns[2])]).astype(np.int32)), flat))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(arrays, names=names)
