"""SimHash classes, near copies, substring dedup and line dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from quartzgrid.llm import common, line_dedup, near_copies, simhash, substring_dedup
from quartzgrid.llm.components import components as component_steps
from tests.llm.helpers import components, empty, frame, odd_rows


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_classes(spark):
    rows = odd_rows()
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.classes(frame(spark)).collect())
    fps = [slow_fingerprint(r[1]) for r in rows]
    roots = components(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    least = {root: min((r[0] for r, x in zip(rows, roots) if x == root and r[0] is not None), default=None) for root in roots}
    assert got == sorted((str(r[0]), f"{fp:016x}", str(least[root])) for r, fp, root in zip(rows, fps, roots))
    assert simhash.classes(empty(spark)).count() == 0


def test_no_link_is_lost(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(400)} | {rng.getrandbits(64) for _ in range(400)}
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    at = {x: k for k, x in enumerate(signed)}
    linked = {(min(at[a], at[b]), max(at[a], at[b])) for a, b in edges}
    assert components(len(fps), lambda i, j: (i, j) in linked) == components(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)


def test_large_groups_by_changed_bits(monkeypatch):
    rng = random.Random(5)
    fps = np.unique(np.array([sum(1 << b for b in rng.sample(range(40), rng.randrange(6))) for _ in range(300)], np.uint64))
    keys = np.zeros(len(fps), np.int64)
    want = sorted(map(tuple, simhash.star(keys, fps, 3).tolist()))
    monkeypatch.setattr(simhash, "ENUMERATE", 10)
    assert sorted(map(tuple, simhash.star(keys, fps, 3).tolist())) == want


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in component_steps(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 140)} | {201: 200}


def slow_passages(rows, window):
    words = [(r[1] or "").encode().split() for r in rows]
    first = {}
    for r, own in zip(rows, words):
        for i in range(len(own) - window + 1):
            if r[0] is not None:
                key = tuple(own[i : i + window])
                first[key] = min(first.get(key, r[0]), r[0])
    out = []
    for r, own in zip(rows, words):
        gone = [False] * len(own)
        for i in range(len(own) - window + 1):
            if r[0] is not None and first[tuple(own[i : i + window])] < r[0]:
                gone[i : i + window] = [True] * window
        kept = b" ".join(w for w, g in zip(own, gone) if not g)
        out.append((str(r[0]), len(own), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_passages(spark):
    rng = random.Random(9)
    rows = odd_rows()
    passage = " ".join(f"p{k}" for k in range(50))
    rows += [(60 + k, " ".join(f"q{rng.randrange(999)}" for _ in range(20)) + " " + passage + f" tail{k}", *[None] * 7) for k in range(5)]
    rows += [(70, "der " * 300, *[None] * 7), (71, "der " * 200, *[None] * 7), (72, " ".join(passage.split()[:49]), *[None] * 7)]
    for window in (50, 5):
        got = substring_dedup.dedup_passages(frame(spark, rows), window, with_text=True).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == slow_passages(rows, window)
        assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert substring_dedup.dedup_passages(empty(spark)).count() == 0


def test_passage_of_more_rows_than_a_batch(spark):
    """A passage that more documents hold than Arrow sends at once, ids in no order: only the least keeps it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        passage = " ".join(f"p{k}" for k in range(60))
        rows = [(k * 37 % 101, f"a{k} " + passage[: len(passage) - k % 3 * 4] + f" z{k} z{k}", *[None] * 7) for k in range(101)]
        rows += [(200 + k, "in out " * (90 + 40 * k), *[None] * 7) for k in range(4)]
        got = substring_dedup.dedup_passages(frame(spark, rows), 50).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == slow_passages(rows, 50)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def edits(a, b):
    if abs(len(a) - len(b)) > 1:
        return 2
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b))
    a, b = sorted((a, b), key=len)
    return 1 if any(b[:i] + b[i + 1 :] == a for i in range(len(b))) else 2


def test_lines(spark):
    line = "w1 w2 w3 w4 w5 w6 w7 w8 w9"
    texts = {1: f"{line}\nshort\n\nother line", 2: f"{line.replace('w5', 'x')}\nshort\nkeep this", 3: f"{line} w10\nw0 {line}", 4: line.replace("w2 ", ""), 5: "a b a b a b a b\na a b a b a b a b\nb a b a b a b a", 6: None, 7: "", 8: "other  line\t\nsolo"}
    rows = [(k, t, "en", "s", 1, "k", "w", 1, 1) for k, t in texts.items()] + [(None, line, *[None] * 7), (9, line, *[None] * 7), (9, line, *[None] * 7)]
    seen, want = [], {}
    for k, text in [*texts.items(), (9, line)]:
        kept = []
        for part in (text or "").split("\n"):
            own = tuple(w for w in re.split("[\x20\x09-\x0d]+", part) if w)
            near = any(own == o or (min(len(own), len(o)) >= 8 and edits(own, o) <= 1) for o in seen)
            if own:
                seen.append(own)
            if not (own and near):
                kept.append(part)
        want[k] = (None if text is None else "\n".join(kept), len((text or "").split("\n")) - len(kept))
    got = line_dedup.dedup_lines(frame(spark, rows), counts=("lines", "removed"))
    assert got.columns[:9] == frame(spark).columns
    found = [(r.doc_id, r.text, r.removed) for r in got.collect()]
    assert len(found) == len(rows)
    assert {(k, t, n) for k, t, n in found if k is not None} == {(k, *v) for k, v in want.items()}
    assert (None, line, 0) in found
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_near_copies(spark):
    rng = random.Random(4)
    rows = odd_rows()
    base = [f"t{rng.randrange(500)}" for _ in range(120)]
    for k in range(8):
        own = list(base)
        for _ in range(k):
            own[rng.randrange(120)] = f"new{rng.randrange(99)}"
        rows.append((200 + k, " ".join(own), *[None] * 7))
    kept = near_copies.keep_one_of_each(frame(spark, rows))
    assert kept.columns == frame(spark).columns
    named = [r for r in rows if r[0] is not None]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((r[1] or "").encode().lower().split() for r in named)]
    like = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    order = sorted(range(len(named)), key=lambda i: named[i][0])
    roots = components(len(named), lambda i, j: like(order[i], order[j]))
    want = sorted(named[order[r]][0] for r in set(roots))
    got = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in got if x is not None) == want
    assert got.count(None) == 2
    assert near_copies.keep_one_of_each(empty(spark)).count() == 0


def test_near_copies_that_repeat_a_phrase(spark):
    rng = random.Random(8)
    rows = []
    for k in range(12):
        own = " ".join(f"t{rng.randrange(10**6)}" for _ in range(300))
        phrase = " ".join(f"p{rng.randrange(10**6)}" for _ in range(5))
        rows += [(2 * k, f"{own} {' '.join([phrase] * 4)}", *[None] * 7), (2 * k + 1, f"{own} {' '.join([phrase] * 100)}", *[None] * 7)]
    assert sorted(r.doc_id for r in near_copies.keep_one_of_each(frame(spark, rows)).collect()) == list(range(0, 24, 2))


def test_pairs_with_few_shingles_are_not_judged_by_fingerprints():
    keys, ids, fps = np.zeros(2, np.int64), np.array([1, 2]), np.array([0, (1 << 30) - 1], np.uint64)
    assert near_copies._band_pairs(keys, ids, fps, np.array([4, 5])).tolist() == [[1, 2]]
    assert len(near_copies._band_pairs(keys, ids, fps, np.array([400, 500]))) == 0


def template_family(rng, members):
    """Texts that share 300 shingles (similarity 0.75); two by two they share more (0.87)."""
    common = " ".join(f"c{k}" for k in range(300))
    out = []
    for k in range(members // 2):
        shared = " ".join(f"s{k}x{m}" for m in range(25))
        out += [f"{common} {shared} " + " ".join(f"u{k}x{side}x{m}" for m in range(25)) for side in range(2)]
    ids = rng.sample(range(10 * members), members)
    return list(zip(ids, out))


def test_near_copies_in_a_family_of_one_template(spark, monkeypatch):
    family = template_family(random.Random(11), 300)
    want = sorted(min(a[0], b[0]) for a, b in zip(family[::2], family[1::2]))
    rows = [(k, t, *[None] * 7) for k, t in family]
    assert sorted(r.doc_id for r in near_copies.keep_one_of_each(frame(spark, rows)).collect()) == want
    monkeypatch.setattr(near_copies, "BLOCK_SHINGLES", 20 * 350)
    assert sorted(r.doc_id for r in near_copies.keep_one_of_each(frame(spark, rows)).collect()) == want


def test_links_between_blocks():
    rng = random.Random(12)
    sets = []
    for k in range(60):
        base = rng.sample(range(10**6), rng.randrange(1, 60)) if k % 3 == 0 else sorted(sets[-1].tolist())
        sets.append(np.unique(np.array(base + rng.sample(range(10**6), rng.randrange(4)), np.uint64)))
    groups = np.array([100 - k + k % 2 for k in range(60)])
    for left, right in ((range(60), range(60)), (range(0, 60, 2), range(1, 60, 2))):
        near = {(i, j) for i in left for j in right if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
        found = set(map(tuple, near_copies.between(sets, groups, np.array(left), np.array(right), 0.8).tolist()))
        assert found <= near
        joined = lambda links: components(60, lambda i, j: groups[i] == groups[j] or (i, j) in links or (j, i) in links)
        assert joined(found) == joined(near)


def test_random_lines_against_brute_force(spark):
    rng = random.Random(21)
    lines = []
    for k in range(500):
        if lines and rng.random() < 0.5:  # a copy with up to two edits of an earlier line
            own = list(rng.choice(lines))
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(own) + 1)
                own[at : at + rng.randrange(2)] = [f"n{rng.randrange(99)}"] * rng.randrange(2)
        else:
            own = [f"w{rng.randrange(12)}" for _ in range(rng.choice([1, 7, 8, 9, 10, 15, 16, 17, 31, 64, 70]))]
        lines.append(own or ["w0"])
    white = ["  ", "\t", " \x0b", "\r", " "]
    texts = [[rng.choice(["", " "]) + "".join(w + rng.choice(white if rng.random() < 0.1 else [" "]) for w in own).rstrip(" ") for own in lines[k : k + 5]] for k in range(0, len(lines), 5)]
    rows = [(k, "\n".join(t), *[None] * 7) for k, t in enumerate(texts)]
    seen, want = [], {}
    for k, part in enumerate(texts):
        kept = []
        for line in part:
            own = tuple(w for w in re.split("[\x20\x09-\x0d]+", line) if w)
            near = any(own == o or (min(len(own), len(o)) >= 8 and edits(own, o) <= 1) for o in seen)
            if own:
                seen.append(own)
            if not (own and near):
                kept.append(line)
        want[k] = "\n".join(kept)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == want


def test_a_line_that_a_third_of_all_documents_hold(spark):
    """The same line, and lines that differ from it in one word each: one row a key after the map side, all but the earliest go."""
    base = [f"w{k}" for k in range(12)]
    rows = [(k, " ".join(base) if k % 3 == 0 else " ".join(base[:5] + [f"x{k}"] + base[6:]), *[None] * 7) for k in range(300)]
    got = line_dedup.dedup_lines(frame(spark, rows), counts=("n", "gone")).collect()
    assert sorted(r.doc_id for r in got if r.gone == 0) == [0]


def test_near_copies_lose_no_pair_of_a_shared_template(spark):
    """1,500 pairs of similarity 0.94 that share a text of 150 words: exactly one of each pair stays."""
    rng = random.Random(13)
    common = " ".join(f"c{k}" for k in range(150))
    rows = []
    for k in range(1500):
        own = [f"o{k}x{m}" for m in range(20)]
        other = [*own[:-1], f"p{k}"]
        rows += [(2 * k, f"{common} {' '.join(own)}", *[None] * 7), (2 * k + 1, f"{common} {' '.join(other)}", *[None] * 7)]
    rng.shuffle(rows)
    assert near_copies.keep_one_of_each(frame(spark, rows)).count() == 1500


def pairs_at_the_bound(rng, pairs):
    """Shingle sets two by two at a similarity of 0.8 or just above: of equal sizes, or one within the other, 4 of 5 at least."""
    sets = []
    for k in range(pairs):
        one = rng.choice([0, 0, 1, 2, 5, 20])  # what each has alone; without, the larger holds the smaller
        shared = 8 * one or rng.choice([4, 8, 40, 200])
        extra = (one, one) if one else (0, shared // 4)
        common = [rng.getrandbits(64) for _ in range(shared)]
        sets += [np.unique(np.array(common + [rng.getrandbits(64) for _ in range(n)], np.uint64)) for n in extra]
    return sets


def found_by_fingerprints(sets, sampling):
    """Pairs of candidates, and the members of each large band (of which all pairs are compared)."""
    sizes = np.array([len(x) for x in sets])
    fps = near_copies.fingerprints(np.concatenate(sets), np.cumsum(sizes) - sizes)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(sets))), pa.array([x.tobytes() for x in fps]), pa.array(sizes)], names=["node", "fp", "n"])
    keyed = pa.Table.from_batches(near_copies._keys(*sampling)(iter([batch]))).sort_by("key").combine_chunks()
    met = pa.Table.from_batches(near_copies._candidates(iter(keyed.to_batches(max_chunksize=5000)))).to_pydict()
    pairs, bands = set(), {}
    for a, b, band in zip(met["a"], met["b"], met["band"]):
        pairs.add((a, b)) if band is None else bands.setdefault(a, set()).add(band)
    return pairs, bands


def test_fingerprints_alone_find_the_pairs():
    sets = pairs_at_the_bound(random.Random(17), 1500)
    for sampling in (near_copies.sampling(len(sets)), near_copies.sampling(200_000)):
        pairs, bands = found_by_fingerprints(sets, sampling)
        assert all((k, k + 1) in pairs or bands.get(k, set()) & bands.get(k + 1, set()) for k in range(0, len(sets), 2))
        assert len([p for p in pairs if len(sets[p[0]]) >= near_copies.FEW_SHINGLES and p[0] // 2 != p[1] // 2]) < len(sets) // 10


def test_fingerprints_are_majorities_of_distinct_shingles():
    rng = random.Random(18)
    sets = [np.unique(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)) for n in (1, 2, 3, 254, 255, 256, 511, 1000)]
    sizes = np.array([len(x) for x in sets])
    got = near_copies.fingerprints(np.concatenate(sets), np.cumsum(sizes) - sizes)
    for own, fp in zip(sets, got):
        for k, salt in enumerate(near_copies._SALTS):
            values = near_copies.mixed(own ^ salt).tolist()
            assert int(fp[k]) == sum(1 << bit for bit in range(64) if 2 * sum(v >> bit & 1 for v in values) > len(own))


def test_texts_are_hashed_in_bounded_parts(monkeypatch):
    monkeypatch.setattr(near_copies, "CHUNK_BYTES", 100)
    texts = ["é" * n for n in (10, 40, 5, 300, 0, 0, 1, 49, 50, 50)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    parts = [(part.num_rows, own) for part, own in near_copies._chunks(batch.slice(1))]
    assert [t for _, own in parts for t in own] == [t.encode() for t in texts[1:]]
    assert all(n == len(own) and (n == 1 or sum(map(len, own)) <= 100) for n, own in parts)


def test_memory_is_given_back_after_the_last_batch(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    through = common.returning_memory(lambda batches: (b for b in batches))(iter([1, 2]))
    assert [next(through), given, next(through), given] == [1, [], 2, []] and list(through) == [] and given == [1]


def test_places_of_documents_that_lose_lines(spark):
    """The places of 300 documents: each is set, and few others are."""
    own, other = (spark.range(k, k + 300).select("id", (F.col("id") * 7).alias("version")) for k in (0, 1000))
    places = {r.slot: r.bits % 2**64 for r in line_dedup._places(own).collect()}
    set_at = lambda df: [places.get(r.p >> 6, 0) >> (r.p & 63) & 1 for r in df.select(line_dedup._place("id", "version").alias("p")).collect()]
    assert sum(set_at(own)) == 300 and sum(set_at(other)) < 10
