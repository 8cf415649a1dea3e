"""Benchmark decontamination in DataFrame operations only: item-sized windows, their SimHash, Hamming blocks, exact similarity.

A window of as many words as an item has is a copy of it if the weighted Jaccard similarity of their word shingles
(weights: how often each occurs) is MIN_SIMILARITY or more.

Which windows are fingerprinted: for each size, those that hold so many shingles of the items of that size, whichever
items, as a copy of any of them must (see `needed`); this bound is exact and no window that could be a copy is left out.
Which item a window may be a copy of is found by its fingerprint alone: the 64 bits in radius + 1 blocks, of which two
fingerprints within the radius have one in common, are looked up in an index of the items' blocks. The distance, then
the exact similarity of the shingles verifies each candidate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzgrid.llm.common import joined_words, text_of
from quartzgrid.storage import BROADCAST_BYTES, Workspace, numbered, place_of

SHINGLE_WORDS, MIN_SIMILARITY = 5, 0.8
#: At similarity 0.8 fingerprints differ in 9.6 of 64 bits on average, with a standard deviation of 2.9 (simulated for
#: 9 to 300 shingles): a pair of just that similarity lies beyond 28 bits with a chance below 10**-8.
RADIUS = 28


def find_leaks(documents: DataFrame, benchmark: DataFrame, shingle_words: int = SHINGLE_WORDS, min_similarity: float = MIN_SIMILARITY, radius: int = RADIUS, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, version, item_id, start, n_words, similarity): for each document and item that it holds a copy of, the most similar window (the first of these), in words.

    Texts are compared in lower case, words without ASCII white space. Items of fewer words than a shingle are one
    shingle of all their words; items without words match nothing. A document shorter than the item is one window.
    Null texts are empty. Null ids stay; version is the hash of the text, by which rows with equal ids are told apart;
    repeated rows give one row. Items with equal ids are items of their own, of which the best counts. Empty tables
    give no rows. Very long texts are taken whole; other columns are not read, whatever their names.
    """
    space = Workspace(documents.sparkSession, "leaks")
    items = _items(benchmark, shingle_words, item_column, item_text, space)
    read = numbered(documents)
    text = text_of(F.col(place_of(documents, text_column)))
    docs = read.select(F.col(place_of(documents, id_column)).cast("long").alias("id"), F.xxhash64(text).alias("version"), text.alias("text"))
    sizes = [r.size for r in items.select("size").distinct().collect()]  # at most shingle_words values
    if not sizes:
        return docs.select("id", "version", *(F.lit(None).cast(t).alias(c) for c, t in (("item_id", "long"), ("start", "int"), ("n_words", "int"), ("similarity", "double")))).limit(0)
    wanted = space.keep(_windows_wanted(docs, items, sizes, min_similarity), "wanted")
    texts = docs.join(_broadcast_if_small(wanted, F.lit(48) + 4 * F.size("starts")), docs["id"].eqNullSafe(wanted["id"]) & (docs["version"] == wanted["version"])).select(docs["id"], docs["version"], "n", "size", "starts", _words(docs["text"]).alias("words"))
    shingled = texts.dropDuplicates(["id", "version", "n", "size"]).select("id", "version", "n", "size", "starts", _sized_shingles(shingle_words).alias("all"))
    each = shingled.select("id", "version", "n", "size", F.explode(F.transform("starts", lambda s: F.struct(s.alias("start"), F.slice("all", s + 1, F.col("n")).alias("shingles")))).alias("window"))
    windows = space.keep(each.select("id", "version", "n", "size", "window.*").withColumn("own", simhash(F.col("shingles"))), "windows")
    pairs = space.keep(_within(windows, items, radius), "pairs")
    same = pairs["id"].eqNullSafe(windows["id"]) & (pairs["version"] == windows["version"]) & (pairs["n"] == windows["n"]) & (pairs["size"] == windows["size"]) & (pairs["start"] == windows["start"])
    named = windows.join(pairs, same).select(windows["id"], windows["version"], windows["start"], windows["shingles"], "item")
    known = items.select("item", "item_id", "n_words", F.col("shingles").alias("item_shingles"))
    scored = named.join(_broadcast_if_small(known, F.lit(64) + 8 * F.size("item_shingles")), "item").withColumn("similarity", similarity(F.col("shingles"), F.col("item_shingles")))
    best = scored.where(F.col("similarity") >= min_similarity - 1e-12).groupBy("id", "version", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words")).alias("best"))
    return best.select("id", "version", "item_id", (-F.col("best.back")).alias("start"), F.col("best.n_words").alias("n_words"), F.col("best.similarity").alias("similarity"))


def drop_leaks(documents: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows, with all their columns, that hold no copy of an item. Rows with null ids and repeated rows are judged by their own text."""
    space = Workspace(documents.sparkSession, "leaking")
    leaks = space.keep(find_leaks(documents, benchmark, id_column=id_column, text_column=text_column, **options).select("id", "version").distinct(), "leaks")
    rows = numbered(documents)
    same = F.col(place_of(documents, id_column)).cast("long").eqNullSafe(F.col("id")) & (F.xxhash64(text_of(F.col(place_of(documents, text_column)))) == F.col("version"))
    return rows.join(_broadcast_if_small(leaks, F.lit(64)), same, "left_anti").toDF(*documents.columns)


def _broadcast_if_small(df: DataFrame, row_bytes: Column) -> DataFrame:
    return F.broadcast(df) if (df.agg(F.sum(row_bytes)).first()[0] or 0) <= BROADCAST_BYTES else df


def _windows_wanted(docs: DataFrame, items: DataFrame, sizes: list[int], min_similarity: float) -> DataFrame:
    """(id, version, n, size, starts): by number and size of shingles, where the windows begin that hold `needed` shingles of items of that kind."""
    probes = items.select("size", "n", F.explode(F.array_distinct("shingles")).alias("h")).distinct()
    words = docs.select("id", "version", _words(F.col("text")).alias("words"))
    hits = []
    for size in sizes:
        positions = words.select("id", "version", (F.size("words") - size + 1).alias("total"), F.posexplode(_shingles(F.col("words"), size)).alias("at", "h"))
        own = probes.where(F.col("size") == size).select("n", "h")
        found = positions.join(_broadcast_if_small(own, F.lit(40)), "h").groupBy("id", "version", "total", "n").agg(F.sort_array(F.collect_set("at")).alias("hits"))
        hits.append(found.withColumn("size", F.lit(size)))
    needed = F.ceil((F.least("n", "total") + F.col("n")) * (min_similarity / (1 + min_similarity)) - 1e-9).cast("int")
    every = reduce(DataFrame.unionByName, hits).withColumn("needed", needed).where(F.size("hits") >= F.col("needed"))
    return every.select("id", "version", "n", "size", _starts().alias("starts")).where(F.size("starts") > 0)


def _words(text: Column) -> Column:
    plain = joined_words(F.lower(text))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " ", -1))


def _shingles(words: Column, size: int) -> Column:
    """Hashes of the runs of `size` words; of an array with fewer words, none."""
    n = F.size(words) - size + 1
    return F.transform(F.slice(words, F.lit(1), F.greatest(n, F.lit(0))), lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, size))))


def _items(benchmark: DataFrame, shingle_words: int, item_column: str, item_text: str, space: Workspace) -> DataFrame:
    """(item, item_id, n_words, size, n, shingles, fingerprint); item is a hash of all that the row holds."""
    read = numbered(benchmark)
    rows = read.select(F.col(place_of(benchmark, item_column)).cast("long").alias("item_id"), _words(text_of(F.col(place_of(benchmark, item_text)))).alias("words")).distinct().where(F.size("words") > 0)
    sized = rows.select("item_id", "words", F.least(F.lit(shingle_words), F.size("words")).alias("size")).withColumn("shingles", _sized_shingles(shingle_words))
    rows = sized.select(F.xxhash64("item_id", "words").alias("item"), "item_id", F.size("words").alias("n_words"), "size", "shingles")
    return space.keep(rows.select("*", F.size("shingles").alias("n"), simhash(F.col("shingles")).alias("fingerprint")), "items")


def _sized_shingles(shingle_words: int) -> Column:
    """The shingles of the words, of as many words as `size` says."""
    words, size = F.col("words"), F.col("size")
    return F.coalesce(*(F.when(size == k, _shingles(words, k)) for k in range(1, shingle_words)), _shingles(words, shingle_words))


def _starts() -> Column:
    """First shingles of the windows that hold `needed` hits: from any `needed` hits in a row on, as far as they fit in."""
    width, last = F.least("n", "total"), F.greatest(F.col("total") - F.col("n"), F.lit(0))
    spans = F.transform(
        F.sequence(F.lit(0), F.size("hits") - F.col("needed")),
        lambda k: F.struct(F.greatest(F.get("hits", k + F.col("needed") - 1) - width + 1, F.lit(0)).alias("low"), F.least(F.get("hits", k), last).alias("high")),
    )
    fitting = F.filter(spans, lambda s: s["low"] <= s["high"])
    return F.array_distinct(F.flatten(F.transform(fitting, lambda s: F.sequence(s["low"], s["high"]))))


def simhash(hashes: Column) -> Column:
    """A bit is set if it is in more than half of the hashes."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.aggregate(hashes, F.lit(0), lambda a, h: a + F.getbit(h, b).cast("int")) * 2 > F.size(hashes))
    number = F.aggregate(F.arrays_zip(bits.alias("bit"), F.sequence(F.lit(0), F.lit(63)).alias("at")), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(F.when(x["bit"], F.call_function("shiftleft", F.lit(1).cast("long"), x["at"])).otherwise(F.lit(0).cast("long"))))
    return number


def _bounds(radius: int) -> list[tuple[int, int]]:
    """(first bit, width) of radius + 1 blocks, at least one."""
    bounds = [64 * k // (radius + 1) for k in range(radius + 2)]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:])]


def _block(number: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(number, first).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1).cast("long"))


def _block_values(fingerprint: Column, radius: int) -> Column:
    return F.array(*(F.struct(F.lit(k).alias("block"), _block(fingerprint, *b).alias("value")) for k, b in enumerate(_bounds(radius))))


def _within(windows: DataFrame, items: DataFrame, radius: int) -> DataFrame:
    """(id, version, n, size, start, item): the items of a window's size whose fingerprint has a block in common with the window's, and lies within the radius.

    A pair comes once, from the first block that it has in common.
    """
    index = items.select("n", "size", "item", "fingerprint", F.explode(_block_values(F.col("fingerprint"), radius)).alias("b")).select("n", "size", "item", "fingerprint", "b.*")
    keyed = windows.select("id", "version", "n", "size", "start", "own", F.explode(_block_values(F.col("own"), radius)).alias("b")).select("id", "version", "n", "size", "start", "own", "b.*")
    met = keyed.join(_broadcast_if_small(index, F.lit(64)), ["n", "size", "block", "value"]).withColumn("differ", F.col("own").bitwiseXOR(F.col("fingerprint")))
    first = F.coalesce(*(F.when(_block(F.col("differ"), *b) == 0, F.lit(k)) for k, b in enumerate(_bounds(radius))))
    return met.where((F.col("block") == first) & (F.bit_count("differ") <= radius)).select("id", "version", "n", "size", "start", "item")


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two arrays of shingles, each shingle weighing as often as it occurs."""
    times = lambda values, x: F.size(F.filter(values, lambda y: y == x))
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    shared = F.when(plain, F.size(F.array_intersect(a, b))).otherwise(F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(times(a, x), times(b, x))))
    return shared / (F.size(a) + F.size(b) - shared)
