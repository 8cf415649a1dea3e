"""Structure of grids: bands, runs, column profiles, row groups, windows with gaps, capped listings, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quartzgrid.storage import cut, free_name

GROUP_LEAST, GROUPS_MOST, EXAMPLES = 50, 8, 5


def bands(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Islands of consecutive values: (keys, lo, hi, n). Without keys the islands are found within ranges of values and joined at their borders."""
    keys = keys or []
    distinct = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("long").alias("v")).distinct()
    if keys:
        order = Window.partitionBy(*keys).orderBy("v")
        return distinct.withColumn("island", F.col("v") - F.row_number().over(order)).groupBy(*keys, "island").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).drop("island")
    # A value begins an island if its predecessor is absent: a join instead of one window over everything.
    before = distinct.select((F.col("v") + 1).alias("v"))
    starts = distinct.join(before, "v", "left_anti").select(F.col("v").alias("lo"))
    after = distinct.select((F.col("v") - 1).alias("v"))
    ends = distinct.join(after, "v", "left_anti").select(F.col("v").alias("hi"))
    return _paired(starts, ends)


def in_order(df: DataFrame, columns: list[str], name: str = "k") -> DataFrame:
    """Adds the row's number, from 1, in the order of the columns, which must tell rows apart.

    No task sees all rows: they are dealt out by ranges, numbered within each, and raised by the sizes of the ranges before.
    The ranges are written first, as their bounds come from a sample that would be drawn anew.
    """
    part = free_name(df.columns, "part")
    dealt = cut(df.repartitionByRange(*columns).withColumn(part, F.spark_partition_id()))
    sizes = dealt.groupBy(part).agg(F.count("*").alias("n"))
    before = sizes.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias("before"))  # a row a range
    placed = dealt.withColumn(name, F.row_number().over(Window.partitionBy(part).orderBy(*columns)))
    return placed.join(F.broadcast(before), part).withColumn(name, F.col(name) + F.col("before")).drop(part, "before")


def _paired(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Starts and ends alternate in their order: each start's end has the same number. There is a row for each island, not for each value."""
    return in_order(starts, ["lo"]).join(in_order(ends, ["hi"]), "k").select("lo", "hi", (F.col("hi") - F.col("lo") + 1).alias("n"))


def nearest_ranks(df: DataFrame, key: str, value: str, row: list[str], shares: dict[str, float]) -> DataFrame:
    """(key, name...): of each key the value at the place ceil(share * n) in the order of values. `row` tells rows apart.

    Rows of a key lie side by side in the order of (key, value), so places are numbers less the key's first one.
    """
    numbered = in_order(df.where(F.col(key).isNotNull() & F.col(value).isNotNull()), [key, value, *row])
    ends = numbered.groupBy(key).agg(F.min("k").alias("first"), F.count("*").alias("n"))
    placed = numbered.join(F.broadcast(ends), key).withColumn("place", F.col("k") - F.col("first") + 1)
    at = lambda share: F.max(F.when(F.col("place") == F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("n"))), F.col(value)))
    return placed.groupBy(key).agg(*(at(share).alias(name) for name, share in shares.items()))


def leading_run(holds: Column, partition: list[str], order: list[str]) -> Column:
    """Whether a row lies before the first row of its partition for which `holds` fails."""
    failed = F.max(F.when(holds, 0).otherwise(1)).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return failed == 0


def trailing_run(holds: Column, partition: list[str], order: list[str]) -> Column:
    failed = F.max(F.when(holds, 0).otherwise(1)).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(0, Window.unboundedFollowing))
    return failed == 0


def inferred_type(kinds: Column, percentage: Column, currency: Column) -> Column:
    """From the set of kinds of a column's cells; kinds is a sorted array."""
    only = lambda *k: F.size(F.array_except(kinds, F.array(*map(F.lit, k)))) == 0
    return (
        F.when(F.size(kinds) == 0, "empty").when(only("number") & percentage, "percentage").when(only("number") & currency, "currency")
        .when(only("number", "date") & F.array_contains(kinds, "number"), "number").when(F.size(kinds) == 1, kinds[0]).otherwise("mixed")
    )


def column_profile(cells: DataFrame, keys: list[str], order: str, display: str, kind: Column, percentage: Column, currency: Column) -> DataFrame:
    """For each column: inferred type, number of distinct display strings, its first five distinct ones in row order."""
    present = cells.where(F.col(display).isNotNull()).withColumn("__kind", kind).withColumn("__p", percentage).withColumn("__c", currency)
    firsts = present.groupBy(*keys, display).agg(F.min(order).alias("__at"), F.collect_set("__kind").alias("__kinds"), F.max("__p").alias("__p"), F.max("__c").alias("__c"))
    counts = firsts.groupBy(*keys).agg(F.count("*").alias("n_distinct"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("__kinds")))).alias("kinds"), F.max("__p").alias("p"), F.max("__c").alias("c"))
    # Each task keeps the first few of a column before the exchange, so what meets in one place is few rows a task.
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("__at", display))
    few = firsts.select(*keys, display, "__at").withColumn("__place", place).where(F.col("__place") <= EXAMPLES)
    found = few.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__place", F.col(display).alias("value")))).alias("found"))
    return counts.join(found, keys).select(*keys, inferred_type(F.col("kinds"), F.col("p"), F.col("c")).alias("inferred_type"), "n_distinct", F.transform("found", lambda x: x["value"]).alias("examples"))


def row_groups(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, group, lo, hi, n): runs of max(50, ceil(n / 8)) rows, so at most eight for each key; keys aren't null, and are few.

    `order` tells the rows of a key apart. Numbers come from ranges of (keys, order), so a key may hold most rows.
    """
    number, first, total = (free_name(df.columns, c) for c in ("number", "first", "total"))
    numbered = in_order(df, [*keys, order], number)
    ends = numbered.groupBy(*keys).agg(F.min(number).alias(first), F.count("*").alias(total))
    size = F.greatest(F.lit(GROUP_LEAST), F.ceil(F.col(total) / GROUPS_MOST))
    placed = numbered.join(F.broadcast(ends), keys).withColumn("group", F.floor((F.col(number) - F.col(first)) / size).cast("int"))
    return placed.groupBy(*keys, "group").agg(F.min(order).alias("lo"), F.max(order).alias("hi"), F.count("*").alias("n"))


def head_tail(df: DataFrame, keys: list[str], order: str, head: int, tail: int) -> DataFrame:
    """The first and last rows of each key, with the number of rows left out between them."""
    n, rn = F.count("*").over(Window.partitionBy(*keys)), F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    counted = df.withColumn("__n", n).withColumn("place", rn)
    kept = counted.where((F.col("place") <= head) | (F.col("place") > F.col("__n") - tail))
    return kept.withColumn("omitted", F.greatest(F.col("__n") - head - tail, F.lit(0).cast("long"))).drop("__n")


def find_capped(df: DataFrame, needle: str, text: Column, order: str, cap: int = 50) -> DataFrame:
    """The first `cap` rows whose text holds the needle, whatever the case, each with the true total."""
    found = df.where(F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(needle.lower())))
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy(order).limit(cap).join(F.broadcast(total))


def first_fitting(sizes: list[tuple[int, Column]], budget: int) -> Column:
    """The first rung, in order, whose size is within the budget; null if none is."""
    return F.coalesce(*(F.when(size <= budget, F.lit(rung)) for rung, size in sizes))
