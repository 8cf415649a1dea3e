"""One document of each group of near copies: five-word shingles, Jaccard similarity of 0.8 or more.

The SimHash operator at similarities at which fingerprints differ in more bits than blocks of 64 can guarantee. A text's
fingerprint has WIDTH majority bits of its distinct shingles; sets of similarity 0.8 differ in 15 % of them, others in
half. Candidates come from the fingerprints alone: each table takes some of the bits as a key (sampled bits in place of
the operator's blocks), among the texts of a key the pivot table discards pairs whose distances to the references
differ by more than the radius, the Hamming distance of two words of the fingerprints decides on the rest, and what
survives is verified on the whole shingle sets. Bits and tables follow the number of texts, so that a key has about a
thousand texts and a pair of similarity 0.8 misses all tables with a chance below 2 in 10,000.

Exact copies are one document before any of this. Texts of a key that are linked by their fingerprints are a band. In a
large band the members are first compared with its first document; bands whose members are then still of several groups
are compared in full, block by block, on the shingle sets alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quartzgrid.llm.common import MASK64, Powers, mixed, returning_memory, rolling, text_of, word_hashes
from quartzgrid.llm.components import Labels, components
from quartzgrid.llm.simhash import CHUNK, pivot_table, whole_groups
from quartzgrid.storage import Workspace, numbered, place_of

SHINGLE_WORDS, MIN_SIMILARITY = 5, 0.8
#: Bits of a fingerprint, and the share of them in which two large sets of similarity 0.8 agree: 1 - acos(8 / 9) / pi.
WIDTH, AGREE = 512, 0.8485
#: Keys have as many bits as give a key 2 ** GROUP_BITS texts at most on average, LEAST_BITS at least; a pair of large sets
#: of similarity 0.8 shares MEETINGS keys on average. Sets under SMALL shingles differ in more bits (4 and 5 shingles: 19 %)
#: and have more tables.
GROUP_BITS, LEAST_BITS, MEETINGS = 11, 5, 12
SMALL, SMALL_MEETINGS = 64, 20
#: Of two 64-bit words of the fingerprints, bits that may differ in the first and, in 64 of all compared, in the mean: at
#: similarity 0.8, 10 of 64 do, with a standard deviation of 3 in one word and 2 in the mean of two.
RADIUS, MEAN_RADIUS = 25, 19
#: Pairs of still smaller sets go straight to the exact check.
FEW_SHINGLES = 8
#: Bands with at most so many documents give all their pairs at once; larger ones are compared in blocks.
ALL_PAIRS = 32
#: What a row of the list of rows that go takes in memory.
_GONE_BYTES = 48
#: What a row of the list of texts whose shingle sets are wanted takes in memory.
_WANTED_BYTES = 80
#: A block of a large band: at most so many shingles and documents (one more document may pass the first bound).
BLOCK_SHINGLES, BLOCK_ROWS = 1 << 20, 1024
#: Fingerprints that are compared with others as a matrix, bytes of text that are hashed at once, words whose hashes are kept.
_CELLS, CHUNK_BYTES, WORDS_KEPT = 1 << 20, 1 << 20, 100_000
_SALTS = np.random.default_rng(7).integers(0, 1 << 64, WIDTH // 64, dtype=np.uint64)


def keep_one_of_each(documents: DataFrame, min_similarity: float = MIN_SIMILARITY, shingle_words: int = SHINGLE_WORDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows, with all their columns, whose id is the smallest of their group of near copies.

    Similarity is the Jaccard similarity of the sets of word shingles of the texts with A-Z in lower case (fewer words:
    one shingle of all); texts without words are copies of each other, null ones too. Groups are connected by links.
    Rows with a null id stay. Of repeated rows (equal id and text) one stays, the first by a hash of its columns. Rows
    with equal ids and other texts are documents of their own; if they are copies of each other one of them stays. Very
    long texts are compared whole. An empty table stays empty. Other columns may have any name. The tables of keys are
    laid out for similarities of MIN_SIMILARITY and more: a lower one is refused.
    """
    if min_similarity < MIN_SIMILARITY:
        raise ValueError(f"similarity below {MIN_SIMILARITY}")
    space = Workspace(documents.sparkSession, "copies")
    rows = numbered(documents)
    own_id, own_text = F.col(place_of(documents, id_column)), F.col(place_of(documents, text_column))
    docs = rows.where(own_id.isNotNull()).select(own_id.cast("long").alias("id"), F.xxhash64(text_of(own_text)).alias("version"), text_of(own_text).alias("text"))
    marked = space.keep(docs.mapInArrow(returning_memory(_signatures(shingle_words)), "id long, version long, s1 long, s2 long, fp binary, n long"), "marked")
    # A node is a text (128 bits of hash); the numbers are written with it.
    distinct = marked.groupBy("s1", "s2").agg(F.min(F.struct("id", "version")).alias("first"), F.max("fp").alias("fp"), F.max("n").alias("n"))
    distinct = space.keep(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct")
    keyed = distinct.select("node", "fp", "n").mapInArrow(returning_memory(_keys(*sampling(distinct.count()))), "key long, node long, f0 long, f1 long, n long")
    met = space.keep(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(returning_memory(_candidates), "a long, b long, band long, n long"), "met")
    pairs = space.keep(met.where("band IS NULL").select("a", "b").distinct(), "pairs")
    involved = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = space.keep(_sets(docs, distinct.join(involved, "node"), shingle_words, space, "involved"), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    stars = components(both.mapInArrow(returning_memory(_similar(min_similarity)), "a long, b long"))
    bands = met.where("band IS NOT NULL").select(F.col("band").alias("key"), F.col("a").alias("node"), "n")
    more = _large_bands(docs, distinct, bands, stars, min_similarity, shingle_words, space)
    if more is not None:
        stars = components(more.unionByName(stars.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    rooted = distinct.select("node", "s1", "s2", "first").join(stars, "node", "left").withColumn("root", F.coalesce("root", "node"))
    winners = rooted.groupBy("root").agg(F.min(F.struct("first", "s1", "s2")).alias("winner"))
    # What a row of each text must be to stay: the group's smallest id, if the text is that row's. A table of its own, so
    # that the join can split a text that a third of the rows have.
    kept = rooted.join(winners, "root").select("s1", "s2", F.when((F.col("winner.s1") == F.col("s1")) & (F.col("winner.s2") == F.col("s2")), F.col("winner.first.id")).alias("stays"))
    kept = space.keep(kept, "kept")
    gone = marked.select("id", "version", "s1", "s2").join(kept, ["s1", "s2"]).where("stays IS NULL OR id <> stays").select("id", "version").distinct()
    gone = space.keep(gone, "gone")
    repeated = not marked.groupBy("id", "version").count().where("count > 1").isEmpty()
    space.drop("marked", "distinct", "met", "pairs", "involved", "sets", "named", "members", "unlike", "cells", "more", "kept")
    same = (own_id.cast("long") == F.col("id")) & (F.xxhash64(text_of(own_text)) == F.col("version"))
    left = rows.join(F.broadcast(gone) if space.small("gone", _GONE_BYTES) else gone, same, "left_anti")
    if repeated:
        named = [c for c, f in zip(rows.columns, documents.schema.fields) if "map<" not in f.dataType.simpleString()]
        order = Window.partitionBy(own_id, F.xxhash64(text_of(own_text))).orderBy(F.xxhash64(*named))
        once = left.where(own_id.isNotNull()).withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")
        left = left.where(own_id.isNull()).unionByName(once)
    return left.toDF(*documents.columns)


def _sets(docs: DataFrame, nodes: DataFrame, shingle_words: int, space: Workspace, name: str) -> DataFrame:
    """(node, shingles) of the texts, each read where it occurs first. Texts stay where they are if the list of nodes is small."""
    wanted = space.keep(nodes.select("node", F.col("first.id").alias("id"), F.col("first.version").alias("version")), name)
    return docs.join(F.broadcast(wanted) if space.small(name, _WANTED_BYTES) else wanted, ["id", "version"]).dropDuplicates(["node"]).select("node", "text").mapInArrow(returning_memory(_shingle_sets(shingle_words)), "node long, shingles binary")


def _large_bands(docs: DataFrame, distinct: DataFrame, bands: DataFrame, stars: DataFrame, least: float, shingle_words: int, space: Workspace) -> DataFrame | None:
    """Links (a, b) between the groups that `stars` leaves in `bands` (key, node, n), those of over ALL_PAIRS texts; None without any.

    A band's texts, by number of shingles, are cut into blocks; each two blocks that hold different groups and sizes
    near enough meet in one place. One link leaves it for each two groups joined there, never all pairs.
    """
    named = bands.join(stars, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = space.keep(named, "named")
    open_bands = named.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    weight = F.greatest(F.col("n"), F.lit(BLOCK_SHINGLES // BLOCK_ROWS))
    before = F.sum(weight).over(Window.partitionBy("key").orderBy("n", "node").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - weight
    members = space.keep(named.join(open_bands, "key").withColumn("block", F.floor(before / BLOCK_SHINGLES)), "members")
    if members.isEmpty():
        return None
    blocks = members.groupBy("key", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("root").alias("x"), F.max("root").alias("y"))
    p, q = (blocks.select("key", *(F.col(c).alias(c + side) for c in ("block", "low", "high", "x", "y"))) for side in ("_p", "_q"))
    met = p.join(q, "key").where((F.col("block_p") <= F.col("block_q")) & (F.col("high_p") >= least * F.col("low_q") - 1e-9))
    cells = space.keep(met.where("least(x_p, x_q) <> greatest(y_p, y_q)").select("key", F.col("block_p").alias("p"), F.col("block_q").alias("q")), "cells")
    sides = cells.select("key", "p", "q", F.col("p").alias("block")).unionByName(cells.select("key", "p", "q", F.col("q").alias("block"))).distinct()
    sets = _sets(docs, distinct.join(members.select("node").distinct(), "node"), shingle_words, space, "unlike")
    dealt = members.join(sides, ["key", "block"]).join(sets, "node").select("key", "p", "q", "block", "node", "root", "shingles")
    return space.keep(dealt.groupBy("key", "p", "q").applyInArrow(_block_links(least), "a long, b long").distinct(), "more")


def _block_links(least: float):
    def run(cell: pa.Table) -> pa.Table:
        blocks, ids, roots = (cell[c].to_numpy() for c in ("block", "node", "root"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in cell["shingles"]]
        left, right = (np.flatnonzero(blocks == cell[c][0].as_py()) for c in ("p", "q"))
        links = between(sets, roots, left, right, least)
        return pa.table({"a": pa.array(ids[links[:, 0]]), "b": pa.array(ids[links[:, 1]])})

    return run


def between(sets: list[np.ndarray], groups: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """Rows (i, j) of links between sets of different groups: they join exactly the groups that all similar pairs of `left` and `right` join."""
    _, first, inverse = np.unique(groups, return_index=True, return_inverse=True)
    labels = Labels(len(sets))
    labels.of[:] = first[inverse]
    sizes = np.array([len(x) for x in sets])
    right = right[np.argsort(sizes[right], kind="stable")]
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    coded = np.split(codes, np.cumsum(sizes)[:-1])
    elements = np.concatenate([coded[j] for j in right])
    ends = np.cumsum(sizes[right])
    marked = np.zeros(len(values), np.int8)
    links = []
    for i in left:
        low = np.searchsorted(sizes[right], least * sizes[i] - 1e-9)
        high = np.searchsorted(sizes[right], sizes[i] / least + 1e-9, "right")
        others = low + np.flatnonzero(labels.of[right[low:high]] != labels.of[i])
        if not len(others):
            continue
        marked[coded[i]] = 1
        if 4 * len(others) > high - low:
            begin = ends[low] - sizes[right[low]]
            hits = np.add.reduceat(marked[elements[begin : ends[high - 1]]], ends[low:high] - sizes[right[low:high]] - begin, dtype=np.int64)[others - low]
        else:
            hits = np.array([np.count_nonzero(marked[coded[j]]) for j in right[others]])
        marked[coded[i]] = 0
        near = right[others[hits >= least * (sizes[i] + sizes[right[others]] - hits) - 1e-9]]
        if len(near):
            # One link a group: the first found.
            near = near[np.unique(labels.of[near], return_index=True)[1]]
            links += [(i, j) for j in near]
            labels.join(np.full(len(near), i), near)
    return np.array(links, np.int64).reshape(-1, 2)


class _Shingles:
    """Hashes of the distinct shingles of many texts, one text after another, each text's in order; each has at least one."""

    def __init__(self, size: int) -> None:
        self.size, self.hashes, self.powers = size, word_hashes(5, WORDS_KEPT), Powers()

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, begin of each text's)."""
        split = [t.split() for t in texts]
        lengths = np.array([len(w) for w in split])
        padded = [w + [b""] * (self.size - len(w)) if len(w) < self.size else w for w in split]
        words = [w for p in padded for w in p]
        values = rolling(np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words)), self.size, self.powers)
        sizes = np.maximum(lengths, self.size)
        counts = sizes - self.size + 1
        begins = np.cumsum(counts) - counts
        at = np.repeat(np.cumsum(sizes) - sizes - begins, counts) + np.arange(counts.sum())
        sets = [np.unique(x) for x in np.split(mixed(values[at]), begins[1:])]
        counts = np.array([len(x) for x in sets])
        return np.concatenate(sets), np.cumsum(counts) - counts


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch with at most CHUNK_BYTES of text, or of one row; only one part's texts are Python objects at a time."""
    ends = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = 0
    while begin < len(ends):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + CHUNK_BYTES, "right")))
        part = batch.slice(begin, end - begin)
        yield part, [t.encode("utf-8", "surrogatepass").lower() for t in part["text"].to_pylist()]
        begin = end


def fingerprints(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """WIDTH majority bits of each text's distinct shingles, as rows of 64-bit words: a bit is 1 if it is set in over half of them."""
    counts = np.diff(np.append(begins, len(hashes)))
    runs = -(-counts // 255)
    first = np.cumsum(runs) - runs
    starts = np.repeat(begins - 255 * first, runs) + 255 * np.arange(runs.sum())
    out = np.empty((len(begins), WIDTH // 64), np.uint64)
    for k, salt in enumerate(_SALTS):
        bits = np.unpackbits(mixed(hashes ^ salt).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # Eight counters in a word: none overflows in 255 shingles.
        counters = np.add.reduceat(bits.view(np.uint64), starts, axis=0)
        sums = np.add.reduceat(counters.view(np.uint8), first, axis=0, dtype=np.int64)
        out[:, k] = np.packbits(2 * sums > counts[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _signatures(size: int):
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = _Shingles(size)
        for whole in batches:
            for batch, texts in _chunks(whole):
                hashes, begins = shingles.of(texts)
                fps = [x.tobytes() for x in fingerprints(hashes, begins)]
                counts = np.diff(np.append(begins, len(hashes)))
                same = [xxhash.xxh3_128_intdigest(b" ".join(t.split())) for t in texts]
                s1, s2 = (np.array([x >> k & MASK64 for x in same], np.uint64).view(np.int64) for k in (64, 0))
                yield pa.RecordBatch.from_arrays([batch["id"], batch["version"], pa.array(s1), pa.array(s2), pa.array(fps, pa.binary()), pa.array(counts)], names=["id", "version", "s1", "s2", "fp", "n"])

    return run


def sampling(texts: int) -> tuple[int, int, int]:
    """(bits of a key, tables, tables for small sets) for so many texts."""
    bits = max(LEAST_BITS, (texts - 1).bit_length() - GROUP_BITS)
    return bits, *(int(np.ceil(n / AGREE**bits)) for n in (MEETINGS, SMALL_MEETINGS))


def _keys(bits: int, tables: int, small_tables: int):
    places = np.random.default_rng(19).permuted(np.tile(np.arange(WIDTH), (small_tables, 1)), axis=1)[:, :bits]
    weights = np.int64(1) << np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                fps = np.frombuffer(b"".join(batch["fp"].to_pylist()), np.uint64).reshape(-1, WIDTH // 64)
                own = np.unpackbits(fps.view(np.uint8), axis=1, bitorder="little")
                counts = batch["n"].to_numpy()
                small = np.flatnonzero(counts < SMALL)
                at = np.concatenate([np.tile(np.arange(len(own)), tables), np.tile(small, small_tables - tables)])
                keys = [(np.int64(t) << np.int64(bits)) + (own if t < tables else own[small])[:, p] @ weights for t, p in enumerate(places)]
                others = (batch["node"].to_numpy(), fps[:, 0].view(np.int64), fps[:, 1].view(np.int64), counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *(pa.array(x[at]) for x in others)], names=["key", "node", "f0", "f1", "n"])

    return run


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key -> pairs (a, b) that may be near copies, and the members (a, band, n) of large bands."""
    for keys, ids, f0, f1, counts in whole_groups(batches, "key", ("node", "f0", "f1", "n"), CHUNK):
        if not len(keys):
            continue
        fps = np.stack([f0, f1], axis=1).view(np.uint64)
        bands = _bands(keys, fps, counts)
        order = np.lexsort((ids, bands))
        bands, ids, fps, counts, keys = (x[order] for x in (bands, ids, fps, counts, keys))
        pairs = _band_pairs(bands, ids, fps, counts)
        _, begins, inverse, sizes = np.unique(bands, return_index=True, return_inverse=True, return_counts=True)
        large = np.flatnonzero(sizes[inverse] > ALL_PAIRS)
        # A band's number: of its key and its first text.
        numbers = mixed(mixed(keys[large].view(np.uint64)) ^ ids[begins[inverse[large]]].view(np.uint64)).view(np.int64)
        for k in range(0, len(pairs), CHUNK):
            part = pairs[k : k + CHUNK]
            nothing = pa.nulls(len(part), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1]), nothing, nothing], names=["a", "b", "band", "n"])
        if len(large):
            yield pa.RecordBatch.from_arrays([pa.array(ids[large]), pa.nulls(len(large), pa.int64()), pa.array(numbers), pa.array(counts[large])], names=["a", "b", "band", "n"])


def _bands(keys: np.ndarray, fps: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each row the least row that it is connected with by pairs of equal keys that may be near copies."""
    bands = np.empty(len(keys), np.int64)
    begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    for begin, end in zip(begins, np.append(begins[1:], len(keys))):
        bands[begin:end] = begin + _linked(fps[begin:end], counts[begin:end])
    return bands


def _linked(fps: np.ndarray, counts: np.ndarray) -> np.ndarray:
    labels, table = Labels(len(fps)), pivot_table(fps[:, 0])

    def join(a: np.ndarray, b: np.ndarray) -> None:
        apart = labels.of[a] != labels.of[b]
        a, b = a[apart], b[apart]
        near = _near(a, b, fps, table, counts)
        labels.join(a[near], b[near])

    order = np.argsort(table[:, 0], kind="stable")
    own, first, second = fps[order, 0], table[order, 0], table[order, 1]
    step = max(1, _CELLS // len(order))
    for k in range(0, len(order), step):
        # In the order of the first coordinate, later rows beyond the radius in it end the block's range.
        last = min(k + step, len(order))
        stop = int(np.searchsorted(first, first[last - 1] + RADIUS, side="right"))
        close = np.bitwise_count(own[k:last, None] ^ own[None, k:stop]) <= RADIUS
        close &= np.abs(second[k:last, None] - second[None, k:stop]) <= RADIUS
        a, b = np.nonzero(close)
        later = a < b
        join(order[k + a[later]], order[k + b[later]])
    small = np.flatnonzero(counts < FEW_SHINGLES)
    step = max(1, _CELLS // max(1, len(small)))
    for k in range(0, len(small), step):
        a, b = np.nonzero(np.arange(k, min(k + step, len(small)))[:, None] < np.arange(len(small))[None, :])
        join(small[k + a], small[b])
    return labels.of


def _near(a: np.ndarray, b: np.ndarray, fps: np.ndarray, table: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether rows a and b may be near copies, by the numbers of their shingles, the pivot table and the fingerprints."""
    least, most = np.minimum(counts[a], counts[b]), np.maximum(counts[a], counts[b])
    own = np.bitwise_count(fps[a] ^ fps[b])
    # Sets of one size below 9 are that similar only if they are equal.
    few = (most < FEW_SHINGLES) & ((least < most) | ~own.any(axis=1))
    near = (own[:, 0] <= RADIUS) & (own.sum(axis=1, dtype=np.int64) <= MEAN_RADIUS * own.shape[1] + 2 * (most < SMALL))
    near &= (np.abs(table[a] - table[b]) <= RADIUS).all(axis=1)
    return (near | few) & (least >= MIN_SIMILARITY * most - 1e-9)


def _band_pairs(keys: np.ndarray, ids: np.ndarray, fps: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Pairs (a, b) that may be near copies of rows sorted by key and id: all of bands of up to ALL_PAIRS, else those with the first."""
    fps = fps.reshape(len(keys), -1)
    begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(begins, len(keys)))
    head, size = np.repeat(begins, sizes), np.repeat(sizes, sizes)
    every = np.arange(len(keys))
    left, right = [head[every > head]], [every[every > head]]
    for step in range(1, ALL_PAIRS):
        at = every[step:]
        at = at[(at - step > head[at]) & (size[at] <= ALL_PAIRS)]
        if not len(at):
            break
        left.append(at - step)
        right.append(at)
    a, b = np.concatenate(left), np.concatenate(right)
    near = _near(a, b, fps, pivot_table(fps[:, 0]), counts) & (ids[a] != ids[b])
    pairs = np.stack([np.minimum(ids[a], ids[b])[near], np.maximum(ids[a], ids[b])[near]], axis=1)
    return np.unique(pairs, axis=0) if len(pairs) else pairs


def _shingle_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = _Shingles(size)
        for whole in batches:
            for batch, texts in _chunks(whole):
                hashes, begins = shingles.of(texts)
                sets = [x.tobytes() for x in np.split(hashes, begins[1:])]
                yield pa.RecordBatch.from_arrays([batch["node"], pa.array(sets, pa.binary())], names=["node", "shingles"])

    return run


def _similar(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch["x"], batch["y"]):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = 0
                if min(len(a), len(b)) >= least * max(len(a), len(b)) - 1e-9:
                    shared = len(np.intersect1d(a, b, assume_unique=True))
                near.append(shared >= least * (len(a) + len(b) - shared) - 1e-9)
            kept = batch.filter(pa.array(near, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept["a"], kept["b"]], names=["a", "b"])

    return run
