"""Two versions of a grid: classification of changes, counts, who reads what changed, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_IMPACT = 20


def changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change) for cells (keys, value, formula, result) that differ: added, removed, kind, formula, result or value.

    Compared null-safely; in this order: presence, having a formula, its text, its saved result, the value.
    """
    pick = lambda df, side: df.select(*keys, *(F.col(c).alias(f"{side}_{c}") for c in ("value", "formula", "result")), F.lit(True).alias(f"{side}_present"))
    both = pick(old, "old").join(pick(new, "new"), keys, "full")
    differs = lambda c: ~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    change = (
        F.when(F.col("old_present").isNull(), "added").when(F.col("new_present").isNull(), "removed")
        .when(F.col("old_formula").isNull() != F.col("new_formula").isNull(), "kind").when(differs("formula"), "formula")
        .when(F.col("new_formula").isNotNull() & differs("result"), "result").when(differs("value"), "value")
    )
    return both.withColumn("change", change).where("change IS NOT NULL").select(*keys, "change", *(f"{s}_{c}" for s in ("old", "new") for c in ("value", "formula", "result")))


def change_counts(changed: DataFrame, by: list[str]) -> DataFrame:
    """Never capped, whatever a listing shows."""
    return changed.groupBy(*by, "change").agg(F.count("*").alias("n"))


def impact(changed: DataFrame, readers: DataFrame, key: str, reader: str, cap: int = MAX_IMPACT) -> DataFrame:
    """(key, n_readers, readers): all readers counted, the first `cap` in order named."""
    distinct = changed.select(key).distinct().join(readers.select(key, reader).distinct(), key)
    counts = distinct.groupBy(key).agg(F.count("*").alias("n_readers"))
    # Ranked before they are collected: a task keeps `cap` readers of a key, however many there are.
    few = distinct.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(reader))).where(F.col("place") <= cap)
    return counts.join(few.groupBy(key).agg(F.array_sort(F.collect_list(reader)).alias("readers")), key)


def names_diff(old: DataFrame, new: DataFrame, name: str, target: str) -> DataFrame:
    both = old.select(name, F.col(target).alias("old_target"), F.lit(1).alias("o")).join(new.select(name, F.col(target).alias("new_target"), F.lit(1).alias("n")), name, "full")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("old_target").eqNullSafe(F.col("new_target")), "changed")
    return both.withColumn("change", change).where("change IS NOT NULL").select(name, "change", "old_target", "new_target")


def reads_changed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(columns, change): edges that only the new version has (added) or only the old one (removed), of cells that both have.

    old and new hold the same columns, `keys` those that name the reading cell. Nulls are values like others.
    """
    columns = old.columns
    here = lambda df, other: df.join(other.select(*keys).distinct(), keys, "left_semi").select(*columns).distinct()
    a, b = here(old, new), here(new, old)
    return b.subtract(a).withColumn("change", F.lit("added")).unionByName(a.subtract(b).withColumn("change", F.lit("removed")))


def differs(a: Column, b: Column, relative: float = 1e-9, absolute: float = 1e-9) -> Column:
    """Numbers beyond tolerance; exactly one null differs."""
    beyond = F.abs(a - b) > F.greatest(relative * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))
    return F.when(a.isNull() | b.isNull(), a.isNull() != b.isNull()).otherwise(beyond)
