"""Rectangle and interval joins, first-match lookups, labels to the left or above."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quartzgrid.functions.a1 import overlaps

#: A span that would fall into more cells of a level than this belongs to a wider one.
WIDE = 64


def range_query(spans: DataFrame, sheet: Column, row_lo: int, row_hi: int, col_lo: int, col_hi: int) -> DataFrame:
    """Spans that meet one rectangle: plain comparisons, which reach the scan."""
    return spans.where(sheet & overlaps(F.col("row_lo"), F.col("row_hi"), F.lit(row_lo), F.lit(row_hi)) & overlaps(F.col("col_lo"), F.col("col_hi"), F.lit(col_lo), F.lit(col_hi)))


def interval_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], width: int, keys: list[str] | None = None) -> DataFrame:
    """All pairs whose integer intervals share a point (and whose `keys` are equal), each once.

    Cells of level n are `width` times WIDE to the power of n. A span's own level is the first at which it lies in WIDE cells at
    most; it is dealt out over its cells of that level and of the wider ones that occur. A pair meets at the wider of its
    two levels, in the cell where the later of the two begins, so no pair comes twice and no span is copied more than
    WIDE times and two or three times a further level. Null or inverted spans meet nothing.
    """
    keys = keys or []

    def sound(df: DataFrame, span: tuple[str, str], side: str) -> DataFrame:
        low, high = (F.col(c).cast("long") for c in span)
        held = df.withColumns({f"__{side}lo": low, f"__{side}hi": high}).where(F.col(f"__{side}lo") <= F.col(f"__{side}hi"))
        cells = (F.col(f"__{side}hi").cast("double") - F.col(f"__{side}lo").cast("double")) / width + 1
        return held.withColumn(f"__{side}level", F.greatest(F.lit(0), F.ceil(F.log(float(WIDE), cells) - 1)).cast("int"))

    a, b = sound(left, left_span, "a"), sound(right, right_span, "b")
    top = max(df.agg(F.max(f"__{side}level")).first()[0] or 0 for df, side in ((a, "a"), (b, "b")))

    def dealt(df: DataFrame, side: str) -> DataFrame:
        each = df.withColumn("__level", F.explode(F.sequence(F.col(f"__{side}level"), F.lit(top))))
        cell = lambda end: F.floor(F.col(f"__{side}{end}") / _cell_width(width, top)).cast("long")
        return each.withColumn("__cell", F.explode(F.sequence(cell("lo"), cell("hi"))))

    met = dealt(a, "a").join(dealt(b, "b"), [*keys, "__level", "__cell"])
    own = F.col("__level") == F.greatest("__alevel", "__blevel")
    first = F.floor(F.greatest("__alo", "__blo") / _cell_width(width, top)) == F.col("__cell")
    out = met.where(own & overlaps(F.col("__alo"), F.col("__ahi"), F.col("__blo"), F.col("__bhi")) & first)
    return out.drop("__alo", "__ahi", "__blo", "__bhi", "__alevel", "__blevel", "__level", "__cell")


def _cell_width(width: int, top: int) -> Column:
    """Of the row's level."""
    out = F.lit(width)
    for level in range(1, top + 1):
        out = F.when(F.col("__level") == level, F.lit(width * WIDE**level)).otherwise(out)
    return out.cast("long")


def first_match(pairs: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Of each key's pairs the first by the order."""
    return pairs.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__rn = 1").drop("__rn")


def parents(spans: DataFrame, regions: DataFrame, key: str, region_ix: str, width: int, default: Column) -> DataFrame:
    """Each span's first meeting region, else the default: (key, parent). Aggregated, not windowed: one row a key."""
    met = interval_join(spans.select(key, "lo", "hi"), regions.select(region_ix, F.col("lo").alias("r_lo"), F.col("hi").alias("r_hi")), ("lo", "hi"), ("r_lo", "r_hi"), width)
    first = met.groupBy(key).agg(F.min(region_ix).alias("parent"))
    return spans.select(key).join(first, key, "left").select(key, F.coalesce(F.col("parent"), default).alias("parent"))


def label_before(partition: list[str], order: list[str], label: Column) -> Column:
    """The nearest non-null label before the row: to the left in a sheet's row, or above in its column."""
    frame = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(label, ignorenulls=True).over(frame)


def cover(cells: DataFrame, merges: DataFrame, value: str) -> DataFrame:
    """Cells in a merged range take its first cell's value. Merges hold (sheet, row_lo, row_hi, col_lo, col_hi)."""
    spots = merges.select("sheet", F.explode(F.sequence("row_lo", "row_hi")).alias("row"), "row_lo", "col_lo", "col_hi")
    spots = spots.select("sheet", "row", F.explode(F.sequence("col_lo", "col_hi")).alias("col"), "row_lo", "col_lo")
    masters = spots.join(cells.select("sheet", F.col("row").alias("row_lo"), F.col("col").alias("col_lo"), F.col(value).alias("__master")), ["sheet", "row_lo", "col_lo"])
    covered = cells.join(masters.select("sheet", "row", "col", "__master"), ["sheet", "row", "col"], "full")
    return covered.withColumn(value, F.coalesce("__master", value)).drop("__master")
