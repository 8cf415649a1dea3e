"""Token counts without token ids: pieces are counted once per distinct pre-token and joined to per-document frequencies.

A byte-level BPE vocabulary never merges across pre-tokens, so a text's count is the sum over its pre-tokens of their
frequency times their number of pieces. Documents are handled in blocks: a block writes, for each of its distinct
pre-tokens, one row with the frequencies of all its documents, so a pre-token that every document holds sends one row
per block and not one per document. Rows meet by pre-token; those of pre-tokens that many documents of a block hold are
dealt over SALTS places, and the rows that name a block's documents over all. What a task has summed for a block goes
on as one row of packed sums, and meets the block's other rows by block.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzgrid.llm.common import text_of
from quartzgrid.storage import picked

#: Documents of a block: at most what thirteen bits hold. Texts of a block: it ends once it holds so many characters.
BLOCK_DOCUMENTS = 8192
BLOCK_CHARS = 30_000_000
#: A frequency has nineteen bits; a larger one is written as several.
MOST = (1 << 19) - 1
#: Letters for which this rule can be written without Unicode properties. Texts with other characters than these and
#: ASCII (control characters apart) take the library's own pre-tokenizer, so no Unicode version comes in.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
UNUSUAL = re.compile(f"[^\t-\r\x20-\x7e{LETTERS}]")
#: The byte-level pre-token rule over those characters.
PRETOKEN = re.compile(f" ?[{LETTERS}]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\\s{LETTERS}0-9]+|\\s+(?!\\S)|\\s+")

#: A pre-token that more documents of a block hold is frequent: it is counted once in each of SALTS places.
FREQUENT, SALTS = 256, 64
#: Postings summed at once, and blocks whose sums a task holds before it writes them.
ENTRIES, HELD_BLOCKS = 1 << 20, 256

_POSTINGS = "pretoken string, block long, salt long, postings binary"
_PARTS = "block long, head boolean, data binary"
_TOTALS = "id long, n_bytes long, n_tokens long"


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # each task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_chars() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 ones for themselves, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def count_tokens(documents: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of `documents`: id, n_bytes (UTF-8) and n_tokens.

    The tokenizer is a file of the tokenizers library with a byte-level pre-tokenizer and no normalizer. Special strings
    inside texts count as the library counts them by default, one token each. Null texts count as empty: 0 bytes, 0
    tokens. A null id is kept. Repeated rows come back as often as they occur. Very long texts are counted whole. An
    empty table gives no rows. Columns other than the two named are not read, whatever their names are. `documents`
    must give its rows in the same order when a task is run again, as a table does.
    """
    docs = picked(documents, {"id": id_column, "text": text_column}).select(F.col("id").cast("long").alias("id"), text_of(F.col("text")).alias("text"))
    shares = docs.mapInArrow(_block_frequencies(tokenizer_path), _POSTINGS)
    # One exchange by pre-token; within a partition equal pre-tokens are neighbours, and each is counted once.
    parts = shares.repartition("pretoken", "salt").sortWithinPartitions("pretoken").mapInArrow(_piece_counts(tokenizer_path), _PARTS)
    whole = parts.repartition("block").sortWithinPartitions("block").mapInArrow(_totals, _TOTALS)
    return whole.select(F.col("id").alias(id_column), "n_bytes", "n_tokens")


def pretokens(tokenizer) -> Callable[[str], list[str]]:
    """The pre-tokens of a text, the library's special strings among them."""
    specials = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
    around = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
    def plain(text: str) -> list[str]:
        if UNUSUAL.search(text):
            return [text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return PRETOKEN.findall(text)

    def split(text: str) -> list[str]:
        if around is None or not any(s in text for s in specials):
            return plain(text)
        return [p for k, part in enumerate(around.split(text)) for p in ([part] if k % 2 else plain(part))]

    return split


class _Codes(dict):
    def __missing__(self, key: str) -> int:
        self[key] = code = len(self)
        return code


class _Block:
    def __init__(self, number: int) -> None:
        self.number, self.codes, self.chars = number, _Codes(), 0
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.code_parts: list[np.ndarray] = []
        self.entry_parts: list[np.ndarray] = []

    def add(self, i: int | None, text: str, tokens: list[str]) -> None:
        at = len(self.ids)
        self.ids.append(i)
        self.sizes.append(len(text.encode("utf-8", "surrogatepass")))
        self.chars += len(text)
        codes, n = np.unique(np.fromiter(map(self.codes.__getitem__, tokens), np.int32, len(tokens)), return_counts=True)
        while len(codes):
            self.code_parts.append(codes)
            self.entry_parts.append((np.minimum(n, MOST) << 13 | at).astype(np.uint32))
            codes, n = codes[n > MOST], n[n > MOST] - MOST

    @property
    def full(self) -> bool:
        return len(self.ids) >= BLOCK_DOCUMENTS or self.chars >= BLOCK_CHARS

    def rows(self) -> Iterator[pa.RecordBatch]:
        """A row for each pre-token; a row with a null pre-token holds the documents themselves."""
        head = np.array([[i or 0, i is None, n] for i, n in zip(self.ids, self.sizes)], dtype="<i8")
        yield self._batch(pa.array([None], pa.string()), np.array([self.number]), pa.array([head.tobytes()], pa.binary()))
        if self.codes:
            codes, entries = np.concatenate(self.code_parts), np.concatenate(self.entry_parts)
            entries = entries[np.argsort(codes, kind="stable")]
            held = np.bincount(codes, minlength=len(self.codes))
            ends = np.concatenate([[0], np.cumsum(held)]) * 4
            data = pa.Array.from_buffers(pa.binary(), len(self.codes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(entries)])
            names, salts = pa.array(list(self.codes), pa.string()), np.where(held > FREQUENT, self.number % SALTS + 1, 0)
            for k in range(0, len(names), 50_000):
                yield self._batch(names[k : k + 50_000], salts[k : k + 50_000], data[k : k + 50_000])

    def _batch(self, names: pa.Array, salts: np.ndarray, data: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([names, pa.array(np.full(len(names), self.number)), pa.array(salts), data], names=["pretoken", "block", "salt", "postings"])


def _block_frequencies(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = pretokens(load_tokenizer(path))
        number = TaskContext.get().partitionId() << 32  # a block's number starts at its partition's
        block = _Block(number)
        for batch in batches:
            for i, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
                block.add(i, text, split(text))
                if block.full:
                    yield from block.rows()
                    number += 1
                    block = _Block(number)
        if block.ids:
            yield from block.rows()

    return run


def _piece_counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(path)
        specials = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
        chars, cut_up = byte_chars(), tokenizer.model.tokenize
        last: tuple[str | None, int] = (None, 0)
        sums = _Sums()
        for batch in batches:
            heads = batch["pretoken"].is_null()
            if heads.true_count:
                part = batch.filter(heads)
                yield _part(part["block"], True, part["postings"])
                batch = batch.filter(pc.invert(heads))
            if not batch.num_rows:
                continue
            coded = batch["pretoken"].dictionary_encode()
            names = coded.dictionary.to_pylist()
            pieces = [last[1] if x == last[0] else 1 if x in specials else len(cut_up(x.encode("utf-8", "surrogatepass").decode("latin1").translate(chars))) for x in names]
            codes = coded.indices.to_numpy()
            last = (names[codes[-1]], pieces[codes[-1]])
            yield from sums.add(batch["block"].to_numpy(), np.array(pieces, np.int64)[codes], batch["postings"])
        yield from sums.flush()

    return run


class _Sums:
    """Tokens of the documents of each block, as far as a task has summed them."""

    def __init__(self) -> None:
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0
        self.held: dict[int, np.ndarray] = {}

    def add(self, blocks: np.ndarray, pieces: np.ndarray, postings: pa.Array) -> Iterator[pa.RecordBatch]:
        lengths, entries = _entries(postings)
        self.waiting.append((np.repeat(blocks, lengths) << 13 | entries & 8191, (entries >> 13) * np.repeat(pieces, lengths)))
        self.size += len(entries)
        if self.size >= ENTRIES:
            yield from self._sum()

    def _sum(self) -> Iterator[pa.RecordBatch]:
        if self.waiting:
            keys, n = (np.concatenate(x) for x in zip(*self.waiting))
            blocks, at = np.unique(keys >> 13, return_inverse=True)
            # Sums of a million products of 19 bits and a word's pieces: far below 2**53, so doubles are exact.
            totals = np.bincount(at << 13 | keys & 8191, n, len(blocks) << 13).astype(np.int64).reshape(-1, BLOCK_DOCUMENTS)
            for block, own in zip(blocks.tolist(), totals):
                self.held[block] = self.held[block] + own if block in self.held else own.copy()
            self.waiting, self.size = [], 0
        if len(self.held) >= HELD_BLOCKS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.waiting:
            yield from self._sum()
        held, self.held = self.held, {}
        for block, totals in held.items():
            at = np.flatnonzero(totals)
            while len(at):
                n = np.minimum(totals[at], MOST)
                yield _part(pa.array([block]), False, pa.array([(n << 13 | at).astype(np.uint32).tobytes()], pa.binary()))
                totals[at] -= n
                at = at[totals[at] > 0]


def _entries(postings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many numbers of 32 bits each row holds, and the numbers of all rows."""
    ends = np.frombuffer(postings.buffers()[1], np.int32)[postings.offset : postings.offset + len(postings) + 1]
    data = np.frombuffer(postings.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return np.diff(ends) // 4, data.view(np.uint32).astype(np.int64)


def _part(blocks: pa.Array, head: bool, data: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([blocks, pa.array(np.full(len(blocks), head)), data], names=["block", "head", "data"])


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block -> a row for each of its documents, in which all sums meet."""
    block, head, sums = None, b"", np.zeros(BLOCK_DOCUMENTS, np.int64)

    def documents() -> pa.RecordBatch:
        rows = np.frombuffer(head, "<i8").reshape(-1, 3)
        ids = pa.array(rows[:, 0].copy(), mask=rows[:, 1] == 1)
        return pa.RecordBatch.from_arrays([ids, pa.array(rows[:, 2].copy()), pa.array(sums[: len(rows)].copy())], names=["id", "n_bytes", "n_tokens"])

    for batch in batches:
        for number, is_head, data in zip(batch["block"].to_pylist(), batch["head"].to_pylist(), batch["data"].to_pylist()):
            if number != block:
                if block is not None:
                    yield documents()
                block, head = number, b""
                sums[:] = 0
            if is_head:
                head = data
            else:
                entries = np.frombuffer(data, np.uint32).astype(np.int64)
                sums[entries & 8191] += entries >> 13  # a row has each document once
    if block is not None:
        yield documents()
