"""Packing and token counts against the tokenizers library."""

import sys
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quartzgrid.llm import packing, token_counts
from tests.llm.helpers import empty, frame, odd_rows

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["it's we'll 'reason rock'roll", "a... b,, c!! <|endoftext|> x<|startoftext|>y", "≠ é ǅ İstanbul ΣΑΣ 漢字 😀 ½ ²", "  lead\ttabs \x1c\x85 end  ", "x" * 3000, "3.14 a.b ,. ...", "naïve café ÀÉ nbsp", "  ‐– …"]


def test_counts_are_the_librarys(spark):
    library = Tokenizer.from_file(BYTE)
    rows = odd_rows() + [(100 + k, t, *[None] * 7) for k, t in enumerate(ODD)]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(frame(spark, rows), BYTE).collect())
    want = sorted((str(r[0]), len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    assert got == want
    assert token_counts.count_tokens(empty(spark), BYTE).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_pretokens_are_the_librarys(text):
    library = Tokenizer.from_file(BYTE)
    split, chars = token_counts.pretokens(library), token_counts.byte_chars()
    n = sum(1 if p == "<|endoftext|>" else len(library.model.tokenize(p.encode().decode("latin1").translate(chars))) for p in split(text))
    assert n == len(library.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def words():
    return packing._Tokens(WORD), Tokenizer.from_file(WORD)


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text("aB'.,! é\n3½", max_size=40)))
def test_ids_are_the_librarys(words, text):
    own, library = words
    ids, at, penalties = own.of(text, 2)
    assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids + [2]
    assert at[-1] == len(ids) // 4 and penalties[-1] == 0 and (np.diff(at) > 0).all()


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(words, text):
    own, library = words
    assert np.frombuffer(own.of(text, 2)[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids + [2]


def test_pieces_hold_each_id_once(spark):
    library = Tokenizer.from_file(WORD)
    pieces = packing.pack(frame(spark), WORD, length=256, with_ids=True).collect()
    sequences = defaultdict(list)
    for p in pieces:
        assert zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32 and len(p.ids) == p.length
        sequences[p.sequence_id].append(p)
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 256
    got = sorted(x for p in pieces for x in p.ids)
    want = sorted(x for r in odd_rows() for x in library.encode(r[1] or "", add_special_tokens=False).ids + [2])
    assert got == want
    assert packing.pack(empty(spark), WORD).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 16), st.sampled_from([0.0, 6.0, 48.0])), min_size=1, max_size=14))
def test_cuts_cost_least(gaps):
    positions = np.cumsum([0] + [g for g, _ in gaps])
    penalties = np.array([0.0] + [p for _, p in gaps])
    length = 16

    def cost(ends):
        total, start = 0.0, 0
        for j in ends:
            size = int(positions[j] - positions[start])
            if size > length:
                return float("inf")
            total += packing.SEQUENCE + penalties[j] + (0 if size & (size - 1) == 0 else length - size)
            start = j
        return total

    n = len(gaps)
    best = min(cost([k + 1 for k in range(n - 1) if mask >> k & 1] + [n]) for mask in range(1 << (n - 1)))
    assert cost(packing.best_cuts(positions, penalties, length)) == best


def test_pieces_say_where_they_come_from_across_runs(spark, monkeypatch):
    """doc_id, start, order, doc_tokens and crc of each piece, where runs of the dynamic programme end inside documents."""
    from tests.llm.test_pipeline import check_pieces

    monkeypatch.setattr(packing, "RUN_TOKENS", 700)
    texts = {k: " ".join(f"word{(j * 7 + k) % 90}" + "." * (j % 9 == 0) for j in range(n)) for k, n in enumerate([5, 900, 1, 0, 260, 3000, 40, 700])}
    rows = [(k, t, *[None] * 7) for k, t in texts.items()]
    check_pieces(texts, packing.pack(frame(spark, rows), WORD, length=256).collect())


def test_a_pretoken_that_all_documents_hold(spark, monkeypatch):
    """Blocks of few documents, frequent pre-tokens dealt over several places: the counts are the library's."""
    library = Tokenizer.from_file(BYTE)
    monkeypatch.setattr(token_counts, "BLOCK_CHARS", 2000)
    monkeypatch.setattr(token_counts, "FREQUENT", 2)
    monkeypatch.setattr(token_counts, "HELD_BLOCKS", 2)
    monkeypatch.setattr(token_counts, "ENTRIES", 50)
    rows = [(k, f"the the quick {k} " * (k % 7) + "the end", *[None] * 7) for k in range(300)]
    got = sorted((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(frame(spark, rows), BYTE).collect())
    assert got == [(r[0], len(library.encode(r[1], add_special_tokens=False).ids)) for r in rows]


def test_texts_together_are_as_texts_alone(words):
    """Boundaries of a group of texts are computed at once; each text gets those that it has alone, and the library's ids."""
    own, library = words
    texts = ["", *ODD, "", ". .", "one. two. ", "no end " * 700, "ÉCOLE Ñandú. Ⱥb ĸ İx", "", "a. " * 900, "<|endoftext|>. É", "."]
    for longest in (1, 3, 512):
        together = list(own.each(texts, 2, longest))
        assert len(together) == len(texts)
        for text, (ids, at, penalties) in zip(texts, together):
            alone = own.of(text, 2, longest)
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids + [2] and ids == alone[0]
            assert at.tolist() == alone[1].tolist() and penalties.tolist() == alone[2].tolist()
            assert at[-1] == len(ids) // 4 and penalties[-1] == 0 and (np.diff(at, prepend=0) > 0).all() and np.diff(at, prepend=0).max() <= longest


def test_pieces_across_groups_of_texts(spark, monkeypatch):
    from tests.llm.test_pipeline import check_pieces

    monkeypatch.setattr(packing, "GROUP_CHARS", 60)
    monkeypatch.setattr(packing, "RUN_TOKENS", 300)
    texts = {k: " ".join(f"word{(j + k) % 30}" + "." * (j % 6 == 5) for j in range(k * 7 % 23)) for k in range(120)} | {500: "long text " * 400}
    check_pieces(texts, packing.pack(frame(spark, [(k, t, *[None] * 7) for k, t in texts.items()]), WORD, length=128).collect())


def test_a_new_word_takes_few_calls():
    """Much of the packing's time goes to words not seen before and to short texts: calls are counted, as seconds vary."""
    texts = [" ".join("".join("abcdefghij"[int(c)] for c in str(10_000 + 20 * k + j)) + "é" * (j % 3 == 0) for j in range(20)) + "." for k in range(300)]
    own, calls = packing._Tokens(WORD), [0]

    def count(frame, event, arg):
        calls[0] += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        found = list(own.each(texts, 2))
    finally:
        sys.setprofile(None)
    assert len(found) == 300 and calls[0] < 18 * 6000
