"""The pipeline, stage by stage, against plain Python on the same rows."""

import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from quartzgrid.llm import quality_classifier
from tests.llm.helpers import components

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def made(seed=3):
    rng = random.Random(seed)
    good = lambda n: " ".join(rng.choice("river slowly reading window garden letter morning quiet answer paper".split()) + rng.choice(["", ".", ","]) for _ in range(n))
    texts = ["\n".join(good(rng.randrange(3, 40)) for _ in range(rng.randrange(1, 6))) for _ in range(40)]
    texts += ["BUY!! NOW$$ ### CHEAP!! " * rng.randrange(5, 20) for _ in range(20)]
    shared = good(14)
    texts += [f"{good(10)}\n{shared}\n{good(9)}" for _ in range(4)] + [f"{good(8)}\n{shared.replace('river', 'stream', 1)} end" for _ in range(2)]
    base = good(120)
    texts += [base, base, base + " tail", " ".join(base.split()[:119]), None, ""]
    item = " ".join(f"question{k}" for k in range(30))
    texts += [f"{good(12)} {item} {good(5)}", f"{good(12)} {' '.join(item.split()[:12])}"]
    rng.shuffle(texts)
    docs = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    labels = [(k, 0 if t and "BUY" in t else 1, 0) for k, t in enumerate(texts)]
    return docs, labels, [(1, item), (2, "something else entirely that nobody wrote down here today")]


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_lines(docs):
    seen, out = [], []
    for k, text, *rest in sorted(docs):
        kept = []
        for part in (text or "").split("\n"):
            own = part.split()
            near = own and any(own == o or (min(len(own), len(o)) >= 8 and one_edit(own, o)) for o in seen)
            if own:
                seen.append(own)
            if not near:
                kept.append(part)
        lost = len((text or "").split("\n")) - len(kept)
        new = "\n".join(kept) if lost else text
        out.append((k, new, *rest[:2], len(new) if lost else rest[2]))
    return out


def slow_copies(docs):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for _, t, *_ in docs)]
    roots = components(len(docs), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    return [d for k, d in enumerate(docs) if roots[k] == k]


def slow_leaks(docs, items):
    def holds(text, item):
        words, own = (text or "").lower().split(), item.lower().split()
        grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        for a in range(max(1, len(words) - len(own) + 1)):
            x, y = grams(words[a : a + len(own)]), grams(own)
            shared = len(set(x) & set(y))
            if x and shared >= 0.8 * (len(x) + len(y) - shared):
                return True
        return False

    return [d for d in docs if not any(holds(d[1], i) for _, i in items)]


def test_stages_against_plain_python(spark, tmp_path):
    docs, labels, items = made()
    spark.createDataFrame(docs, DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality", "lines", "near_duplicates", "decontaminate", "pack"]
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    rows = lambda df: sorted(tuple(r) for r in df.collect())

    out = steps["quality"](spark, at, str(tmp_path))
    machine = quality_classifier.train(at, spark.read.parquet(str(tmp_path / "labels.parquet")))
    good = {r.doc_id for r in quality_classifier.score(at, machine).collect() if r.score >= 0.3}
    assert out.columns == at.columns and rows(out) == [d for d in docs if d[0] in good]
    assert sum(d[0] in good for d in docs if d[1] and "BUY" not in d[1]) >= 0.95 * sum(bool(d[1]) and "BUY" not in d[1] for d in docs) and not any("BUY" in (d[1] or "") for d in docs if d[0] in good)

    want = slow_lines([d for d in docs if d[0] in good])
    at = spark.createDataFrame([d for d in docs if d[0] in good], DOCUMENTS)
    out = steps["lines"](spark, at, str(tmp_path))
    assert out.columns == at.columns and rows(out) == want and any(w[1] != d[1] for w, d in zip(want, [d for d in docs if d[0] in good]))

    at, before = spark.createDataFrame(want, DOCUMENTS), want
    want = slow_copies(before)
    assert rows(steps["near_duplicates"](spark, at, str(tmp_path))) == want and len(want) < len(before)

    at, before = spark.createDataFrame(want, DOCUMENTS), want
    want = slow_leaks(before, items)
    assert rows(steps["decontaminate"](spark, at, str(tmp_path))) == want and len(want) < len(before)

    at = spark.createDataFrame(want, DOCUMENTS)
    pieces = steps["pack"](spark, at, str(tmp_path)).collect()
    check_pieces({d[0]: d[1] for d in want}, pieces)
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).drop("sequence_id", "offset").collect()))
    whole = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {d[0] for d in want}


def check_pieces(texts, pieces):
    import zlib

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for k, t in texts.items()}
    covered = {k: [] for k in texts}
    for p in pieces:
        own = ids[p.doc_id][p.start : p.start + p.length]
        assert p.doc_tokens == len(ids[p.doc_id]) and len(own) == p.length > 0
        assert p.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own))
        covered[p.doc_id] += range(p.start, p.start + p.length)
    assert all(sorted(c) == list(range(len(ids[k]))) for k, c in covered.items())
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
