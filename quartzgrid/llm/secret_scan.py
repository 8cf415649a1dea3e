"""Secret scans with corpus-wide ownership: who holds a candidate tells an example that is widely copied from a credential of one owner.

Spans come from pairs of built-in functions: the texts between matches (split) and the matches (regexp_extract_all); the
running sum of their lengths gives the offsets. Candidate values are hashed and counted by owner and repository in two
steps (first per owner and repository, then per value), so a value in a third of all rows is a few rows by then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzgrid.llm.common import bound, running, text_of
from quartzgrid.storage import Workspace

#: Patterns and least lengths of the base kinds, in the order of the kinds.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]+", "[0-9a-f]{24,}"
#: A maximal run of 24 or more is what a leftmost match of any length that reaches 24 is; shorter ones are dropped anyway.
KINDS = (("assign", ASSIGN, 1, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))
#: The method's own kind: runs of credential characters, letters and at least one digit in six, that only one owner has.
OWNED = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
WIDE_OWNERS = 3
#: A value in so many repositories, be they of one owner, is an example too.
WIDE_REPOSITORIES = 5
#: What a row of the ownership counts takes in memory.
_COUNT_BYTES = 48


def matches(text: Column, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, end, value>> of the leftmost matches that don't overlap and whose group has `least` characters."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if not group else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.transform(F.split(text, pattern, -1), F.length)
    # A match starts where the one before it ends, and the text between them later.
    plus = lambda a, b: a + b
    parts = F.arrays_zip(found.alias("whole"), values.alias("value"), F.slice(between, 1, F.size(found)).alias("gap"))
    ends = lambda parts: running(F.transform(parts, lambda x: x["gap"] + F.length(x["whole"])), plus, F.lit(0))
    span = lambda x, end: F.struct((end - F.length(x["whole"])).alias("start"), end.alias("end"), x["value"].alias("value"))
    spans = bound(parts, lambda parts: F.filter(F.zip_with(parts, ends(parts), span), lambda s: F.length(s["value"]) >= least))
    return F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def scan(documents: DataFrame, repository: Column, owner: Column, id_column: str = "doc_id", text_column: str = "text", wide_owners: int = WIDE_OWNERS, wide_repositories: int = WIDE_REPOSITORIES) -> DataFrame:
    """One row per row of `documents`: id, base and spans (arrays of kind, start, end, value, n_owners, n_repositories, live), in the order of start and kind.

    Offsets are code points, the end exclusive. `base` holds the spans of the three fixed kinds, `spans` also those of
    the kind `owned`: other credential-like runs that one owner alone has. A value that `wide_owners` owners or more
    hold, or `wide_repositories` repositories, is a widely copied example, not live. Null texts are empty and have no spans. Rows with null repository or
    owner count as one repository or owner of their own. Null ids stay; repeated rows come back as often as they occur.
    An empty table gives no rows. Very long texts are scanned whole; columns that no argument names are not read.
    """
    text = text_of(F.col(text_column))
    rows = documents.select(F.col(id_column).cast("long").alias("id"), F.coalesce(repository.cast("string"), F.lit("")).alias("repository"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), text.alias("text"))
    kinds = [F.transform(matches(F.col("text"), pattern, group, least), _marked(k, name)) for k, (name, pattern, group, least) in enumerate(KINDS)]
    own = F.filter(F.transform(matches(F.col("text"), OWNED, 0, 20), _marked(len(KINDS), "owned")), lambda s: _credential_like(s["value"]))
    found = rows.withColumn("base", F.concat(*kinds)).withColumn("own", own)
    apart = F.filter("own", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    # Small beside the texts, and read three times below.
    space = Workspace(documents.sparkSession, "secrets")
    found = space.keep(found.select("id", "repository", "owner", F.concat("base", apart).alias("found")), "found")
    # Rows without candidates need no join; the others are told apart by their own hash of all that they hold.
    holding = found.where(F.size("found") > 0).withColumn("row", F.xxhash64("id", "repository", "owner", "found"))
    spans = holding.select("row", "repository", "owner", F.explode("found").alias("span")).withColumn("value_hash", F.xxhash64("span.value", F.length("span.value")))
    counts = space.keep(ownership(spans), "counts")  # a table of its own, so that the join can split a value that is everywhere
    shared = F.broadcast(counts) if space.small("counts", _COUNT_BYTES) else counts
    live = (F.col("n_owners") < wide_owners) & (F.col("n_repositories") < wide_repositories)
    judged = spans.join(shared, "value_hash").select("row", F.col("span").withField("n_owners", F.col("n_owners")).withField("n_repositories", F.col("n_repositories")).withField("live", live).alias("span"))
    judged = judged.where("span.kind <> 'owned' OR span.n_owners = 1")
    kept = judged.groupBy("row").agg(F.array_sort(F.collect_set("span")).alias("spans"))
    out = holding.select("id", "row").join(kept, "row", "left").select("id", "spans").unionByName(found.where(F.size("found") == 0).select("id", F.lit(None).cast(kept.schema["spans"].dataType).alias("spans")))
    spans = F.coalesce("spans", F.array().cast(kept.schema["spans"].dataType))
    return out.select(F.col("id").alias(id_column), F.filter(spans, lambda s: s["kind"] != "owned").alias("base"), spans.alias("spans"))


def ownership(spans: DataFrame) -> DataFrame:
    """(value_hash, n_owners, n_repositories) over all candidates: distinct pairs first, each in its place."""
    pairs = spans.select("value_hash", "owner", "repository").distinct()
    owners = pairs.groupBy("value_hash", "owner").agg(F.count("*").alias("repositories"))
    return owners.groupBy("value_hash").agg(F.count("*").alias("n_owners"), F.sum("repositories").alias("n_repositories"))


def _marked(order: int, kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value"))


def _credential_like(value: Column) -> Column:
    digits = F.length(value) - F.length(F.regexp_replace(value, "[0-9]", ""))
    letters = F.regexp_like(value, F.lit("[A-Za-z]"))
    return letters & (digits * 6 >= F.length(value))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
