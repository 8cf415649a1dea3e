"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

Two lines are near copies if they are equal as words, or if both have MIN_WORDS words or more and one edit of a word
(substitution, insertion or deletion) makes one the other. A line's deletion neighbourhood is the line without one word,
for each of its words; lines within the bound have an equal variant:
  - lines of n words that differ in one place are equal without it: key (n, place, hash of the rest);
  - a line of n + 1 words that holds one more is, without it, the shorter line: key (n, hash of the words).
The earliest line of a key goes on against the others of the key, not all against all, and each link is verified on the
words.

Before that, lines that can't have a near copy are left out: one edit leaves the first or the second half of the shorter
line whole, so a line goes on only if a line of other words shares a half of it, and only with the kinds of variants
that the partner's number of words asks for. Halves are compared by 64-bit hashes, as least and greatest line name of
a half: a third of all rows may share one, it is one row after the map side's aggregation.

A line's words joined by single spaces stand for it: names and halves are hashes of strings, and no line is split into
an array of words but those that go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzgrid.llm.common import bound, joined_words, running, text_of
from quartzgrid.storage import Workspace, free_name, numbered, place_of

MIN_WORDS = 8
#: What a row of the tables that may be broadcast takes in memory.
_HALF_BYTES, _MARK_BYTES, _DOCUMENT_BYTES = 40, 96, 160
#: Bits of the set of documents that lose lines.
_PLACES = 1 << 22


def dedup_lines(documents: DataFrame, min_words: int = MIN_WORDS, id_column: str = "doc_id", text_column: str = "text", counts: tuple[str, str] | None = None, length_column: str | None = None) -> DataFrame:
    """The rows with all their columns, their text without the lines that an earlier line repeats.

    Order is that of id, then of the line in its document. A line goes if an earlier line, whether that one stays or
    not, has the same words or is within one word's edit of it. Lines without words always stay. A null text stays
    null. Rows with a null id stay as they are and remove nothing. Of rows with equal ids, lines of the same number and
    words count as one line; other lines at equal places don't remove each other. Repeated rows come back as often as
    they occur, all changed alike. Very long lines and texts are taken whole. An empty table gives no rows.

    `counts` names two more columns, the numbers of lines before and of those removed; `length_column`, if the table
    has it, becomes the length of a text that has lost lines. Any other column may have any name.
    """
    spark, columns = documents.sparkSession, documents.columns
    space = Workspace(spark, "lines")
    rows = numbered(documents)
    own_id, own_text = (F.col(place_of(documents, c)) for c in (id_column, text_column))
    docs = rows.where(own_id.isNotNull()).select(own_id.cast("long").alias("id"), text_of(own_text).alias("text"))
    removed = removed_lines(docs.select("id", F.xxhash64("text").alias("version"), "text"), min_words, space)
    gone = space.keep(removed.groupBy("id", "version").agg(F.collect_set("line").alias("gone")), "gone")
    space.drop("hashed", "marks")
    joined = rows.withColumns({"own_id": own_id.cast("long"), "own_version": F.xxhash64(text_of(own_text))})
    # Only documents that may lose lines meet their list by a shuffle; the others stay where they are read.
    joined = joined.join(F.broadcast(space.keep(_places(gone), "places")), F.shiftright(_place("own_id", "own_version"), 6) == F.col("slot"), "left")
    may = F.coalesce(F.getbit("bits", _place("own_id", "own_version").bitwiseAND(63)), F.lit(0)) == 1
    met = joined.where(may).join(gone, (F.col("own_id") == F.col("id")) & (F.col("own_version") == F.col("version")), "left")
    joined = met.select(*rows.columns, "gone").unionByName(joined.where(~may).select(*rows.columns, F.lit(None).cast("array<int>").alias("gone")))
    lines = F.split(text_of(own_text), "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), own_text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    lost = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long")
    out = {place_of(documents, text_column): text}
    joined = joined.select(*(out.get(c, F.col(c)).alias(c) for c in rows.columns), F.size(lines).cast("long").alias("n_lines"), lost.alias("n_lost"))
    if length_column in columns:
        at = place_of(documents, length_column)
        kind = documents.schema[columns.index(length_column)].dataType
        joined = joined.withColumn(at, F.when(F.col("n_lost") > 0, F.length(place_of(documents, text_column)).cast(kind)).otherwise(F.col(at)))
    if counts is None:
        return joined.drop("n_lines", "n_lost").toDF(*columns)
    first = free_name(columns, counts[0])
    return joined.toDF(*columns, first, free_name([*columns, first], counts[1]))


def _place(id_column: str, version: str) -> Column:
    return F.xxhash64(id_column, version).bitwiseAND(F.lit(_PLACES - 1))


def _places(gone: DataFrame) -> DataFrame:
    """(slot, bits): a set of _PLACES bits in words of 64, set at the places of the documents; its size is bounded."""
    place = _place("id", "version")
    return gone.groupBy(F.shiftright(place, 6).alias("slot")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))).alias("bits"))


def removed_lines(docs: DataFrame, min_words: int, space: Workspace) -> DataFrame:
    """docs(id, version, text) -> (id, version, line) of the lines to remove, lines numbered from 0."""
    hashed = space.keep(_lines(docs).select("id", "version", "line", *_names(F.col("words")), _halves(F.col("words"), min_words).alias("halves")), "hashed")
    named = hashed.select("h1", "h2", "id", "line", "version")
    firsts = space.keep(named.groupBy("h1", "h2").agg(F.min(F.struct("id", "line", "version")).alias("first"), F.count("*").alias("times")), "firsts")
    near = near_copies(docs, hashed, firsts, space)
    # Each occurrence but the first of its words goes, and the first too if it is a near copy of an earlier line.
    marks = firsts.join(near, ["h1", "h2"], "left").where("times > 1 OR near").select("h1", "h2", F.col("first.id").alias("first_id"), F.col("first.line").alias("first_line"), F.coalesce("near", F.lit(False)).alias("near"))
    marks = space.keep(marks, "marks")
    space.drop("firsts", "near")
    if space.small("marks", _MARK_BYTES):
        marks = F.broadcast(marks)
    later = (F.col("id") > F.col("first_id")) | ((F.col("id") == F.col("first_id")) & (F.col("line") > F.col("first_line")))
    return named.join(marks, ["h1", "h2"]).where(later | F.col("near")).select("id", "version", "line")


def near_copies(docs: DataFrame, hashed: DataFrame, firsts: DataFrame, space: Workspace) -> DataFrame:
    """(h1, h2, near): the names of the lines that are within one edit of an earlier one."""
    chosen = _chosen(docs, _going_on(hashed, space), firsts, space)
    pairs = space.keep(_same_length(chosen, space).unionByName(_around(chosen)).distinct(), "pairs")
    words = chosen.select("h1", "h2", "first", "words")
    own = pairs.join(words, ["h1", "h2"]).select("h1", "h2", F.col("first").alias("own_first"), F.col("words").alias("own"), "p1", "p2")
    both = own.join(words.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("first").alias("other_first"), F.col("words").alias("other")), ["p1", "p2"])
    verified = both.where(within_one_edit(F.split("own", " ", -1), F.split("other", " ", -1)))
    later = F.col("own_first") > F.col("other_first")
    name = F.struct(*(F.when(later, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("h1", "p1"), ("h2", "p2"))))
    near = space.keep(verified.select(name.alias("name")).select("name.*").distinct().withColumn("near", F.lit(True)), "near")
    space.drop("pairs", "chosen", "multiple", "replaced")
    return near


def _going_on(hashed: DataFrame, space: Workspace) -> DataFrame:
    """(h1, h2, replaces, closes): lines that share a half with a line of other words, and the kinds of variants they need."""
    halves = hashed.where("halves IS NOT NULL").select("h1", "h2", F.explode("halves").alias("half")).select("h1", "h2", "half.*")
    same, more = F.when(~F.col("longer"), F.col("h1")), F.when(F.col("longer"), F.col("h1"))
    groups = halves.groupBy("key").agg(F.min(same).alias("low"), F.max(same).alias("high"), F.max(more).alias("more"))
    groups = groups.select("key", F.coalesce(F.col("low") != F.col("high"), F.lit(False)).alias("replaces"), (F.col("low").isNotNull() & F.col("more").isNotNull()).alias("closes"))
    groups = space.keep(groups.where("replaces OR closes"), "groups")
    shared = F.broadcast(groups) if space.small("groups", _HALF_BYTES) else groups
    found = halves.join(shared, "key").where("closes OR NOT longer")
    found = found.groupBy("h1", "h2").agg(F.max(F.col("replaces") & ~F.col("longer")).alias("replaces"), F.max(F.col("closes") & F.col("longer")).alias("closes"), F.max(F.col("closes") & ~F.col("longer")).alias("bases"))
    found = space.keep(found, "found")
    space.drop("groups")
    return found


def _chosen(docs: DataFrame, found: DataFrame, firsts: DataFrame, space: Workspace) -> DataFrame:
    """The lines that go on, with their words. Their texts come by one join on the document of their first occurrence."""
    at = found.join(firsts.select("h1", "h2", "first"), ["h1", "h2"])
    line = F.struct("first.line", "h1", "h2", "replaces", "closes", "bases")
    wanted = space.keep(at.groupBy(F.col("first.id").alias("id"), F.col("first.version").alias("version")).agg(F.collect_list(line).alias("wanted")), "wanted")
    space.drop("found")
    lines = F.split("text", "\n", -1)
    texts = docs.join(F.broadcast(wanted) if space.small("wanted", _DOCUMENT_BYTES) else wanted, ["id", "version"])
    # A repeated row gives its lines twice.
    each = texts.select("id", "version", F.explode(F.transform("wanted", lambda w: w.withField("words", joined_words(F.get(lines, w["line"]))))).alias("w"))
    rows = each.select(F.struct("id", "w.line", "version").alias("first"), "w.h1", "w.h2", "w.replaces", "w.closes", "w.bases", "w.words")
    chosen = space.keep(rows.dropDuplicates(["h1", "h2"]), "chosen")
    space.drop("wanted")
    return chosen


def _same_length(chosen: DataFrame, space: Workspace) -> DataFrame:
    """Pairs (h1, h2, p1, p2) of lines with an equal variant without the word at one place: each line of a key with its earliest."""
    words = F.split("words", " ", -1)
    hashes = F.transform(words, lambda w, i: F.xxhash64(w, i))
    lines = chosen.where("replaces").select("h1", "h2", "first", hashes.alias("hashes")).withColumn("total", _xor(F.col("hashes")))
    variants = lines.select("h1", "h2", "first", F.size("hashes").alias("n"), "total", F.posexplode("hashes").alias("place", "word"))
    variants = space.keep(variants.select("h1", "h2", "first", "n", "place", F.col("total").bitwiseXOR(F.col("word")).alias("rest")), "replaced")
    key = ["n", "place", "rest"]
    several = space.keep(variants.groupBy(*key).agg(F.count("*").alias("lines")).where("lines > 1").select(*key), "multiple")
    members = variants.join(F.broadcast(several) if space.small("multiple", _HALF_BYTES) else several, key)
    earliest = members.groupBy(*key).agg(F.min(F.struct("first", "h1", "h2")).alias("least"))
    joined = members.join(earliest, key).where("h1 <> least.h1 OR h2 <> least.h2")
    return joined.select("h1", "h2", F.col("least.h1").alias("p1"), F.col("least.h2").alias("p2"))


def _around(chosen: DataFrame) -> DataFrame:
    """Pairs (h1, h2, p1, p2) of a line and one that is it without a word."""
    words = F.split("words", " ", -1)
    bases = chosen.where("bases").select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.size(words).alias("n"), _xor(F.transform(words, lambda w, i: F.xxhash64(w, i))).alias("rest"))
    closed = chosen.where("closes").select("h1", "h2", (F.size(words) - 1).alias("n"), F.explode(_closed(words)).alias("rest"))
    return closed.join(bases, ["n", "rest"]).select("h1", "h2", "p1", "p2")


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether one substitution, insertion or deletion of a word, or none, makes array a array b."""
    most, least = F.greatest(F.size(a), F.size(b)), F.least(F.size(a), F.size(b))
    same = lambda x, y: F.coalesce(F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), F.lit(False)) - 1, F.lit(0))
    prefix = lambda x, y: F.when(same(x, y) < 0, most).otherwise(same(x, y))
    return (most - least <= 1) & (prefix(a, b) + prefix(F.reverse(a), F.reverse(b)) >= most - 1)


def _lines(docs: DataFrame) -> DataFrame:
    lines = docs.select("id", "version", F.posexplode(F.split("text", "\n", -1)).alias("line", "content"))
    return lines.select("id", "version", "line", joined_words(F.col("content")).alias("words")).where("words <> ''")


def _names(words: Column) -> list[Column]:
    """Two hashes that name a line's words."""
    return [F.xxhash64(words).alias("h1"), F.xxhash64(F.lit(1), words).alias("h2")]


def _halves(words: Column, min_words: int) -> Column:
    """array<struct<key, longer>>: as one of n words the line's first floor(n / 2) words and the rest; and those halves that
    it would have in common with a line of n - 1 words, taken from its front and from its back. Null below `min_words`.
    """
    n = F.octet_length(words) - F.octet_length(F.replace(words, F.lit(" "), F.lit(""))) + 1

    def half(side: int, base: Column, count: Column, longer: bool) -> Column:
        part = F.call_function("substring_index", words, F.lit(" "), count if side == 0 else -count)
        return F.struct(F.xxhash64(F.lit(side), base, part).alias("key"), F.lit(longer).alias("longer"))

    def halves(n: Column, longer: bool) -> list[Column]:
        front = F.floor(n / 2).cast("int")
        return [half(0, n, front, longer), half(1, n, n - front, longer)]

    own = F.array(*halves(n, False))
    return F.when(n > min_words, F.array(*halves(n, False), *halves(n - 1, True))).when(n == min_words, own)


def _xor(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))


def _closed(words: Column) -> Column:
    """The hashes of the words, numbered anew, without each of them: words before the gap keep their number, later ones have one less."""
    exclusive = lambda a, b: a.bitwiseXOR(b)

    def hashed(words: Column) -> Column:
        return F.struct(F.transform(words, lambda w, j: F.xxhash64(w, j)).alias("here"), F.transform(words, lambda w, j: F.xxhash64(w, j - 1)).alias("back"))

    def summed(x: Column) -> Column:
        changed = running(F.zip_with(x["here"], x["back"], exclusive), exclusive, F.lit(0).cast("long"))
        return F.struct(x["here"].alias("here"), changed.alias("changed"), _xor(x["back"]).alias("moved"))

    def built(x: Column) -> Column:
        # Up to the gap `here` instead of `back`, and of the gap's own word neither.
        return F.array_distinct(F.zip_with(x["here"], x["changed"], lambda h, c: x["moved"].bitwiseXOR(c).bitwiseXOR(h)))

    return bound(bound(bound(words, hashed), summed), built)
