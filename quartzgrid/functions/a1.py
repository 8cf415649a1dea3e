"""Cell coordinates as Column expressions: letters and indices, rectangles in A1 notation, spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest sheet (fixed values of the file format).
MAX_ROW, MAX_COLUMN = 9_999_999, 18_278
_CELL = r"\$?([A-Za-z]{1,3})\$?([1-9][0-9]{0,6})"
RECTANGLE = f"^{_CELL}(?::{_CELL})?$"


def column_index(letters: Column) -> Column:
    """A -> 1, Z -> 26, AA -> 27; null for null."""
    digits = F.filter(F.split(F.upper(letters), ""), lambda c: c != "")
    return F.when(letters.isNotNull(), F.aggregate(digits, F.lit(0), lambda total, c: total * 26 + F.ascii(c) - 64))


def column_letter(index: Column) -> Column:
    """1 -> A, 27 -> AA, up to three letters; null beyond."""
    letter = lambda n: F.chr(n + F.lit(65))
    n = index.cast("int") - 1
    third = (n - 702) % 676 % 26
    return (
        F.when((index < 1) | (index > MAX_COLUMN), F.lit(None).cast("string"))
        .when(index <= 26, letter(n))
        .when(index <= 702, F.concat(letter(F.floor((n - 26) / 26).cast("int")), letter((n - 26) % 26)))
        .otherwise(F.concat(letter(F.floor((n - 702) / 676).cast("int")), letter(F.floor((n - 702) % 676 / 26).cast("int")), letter(third)))
    )


def parse_a1(text: Column) -> Column:
    """struct<row_lo, row_hi, col_lo, col_hi> of a cell or rectangle; null if malformed, inverted or out of range."""
    part = lambda k: F.regexp_extract(text, RECTANGLE, k)
    single = part(3) == ""
    row_lo, col_lo = part(2).try_cast("int"), column_index(part(1))
    row_hi = F.when(single, row_lo).otherwise(part(4).try_cast("int"))
    col_hi = F.when(single, col_lo).otherwise(column_index(part(3)))
    sound = F.regexp_like(text, F.lit(RECTANGLE)) & (row_lo <= row_hi) & (col_lo <= col_hi) & (row_hi <= MAX_ROW)
    return F.when(sound, F.struct(row_lo.alias("row_lo"), row_hi.alias("row_hi"), col_lo.alias("col_lo"), col_hi.alias("col_hi")))


def to_a1(span: Column) -> Column:
    first = F.concat(column_letter(span["col_lo"]), span["row_lo"].cast("string"))
    last = F.concat(column_letter(span["col_hi"]), span["row_hi"].cast("string"))
    return F.when(first == last, first).otherwise(F.concat_ws(":", first, last))


def cell_count(span: Column) -> Column:
    return (span["row_hi"] - span["row_lo"] + 1).cast("long") * (span["col_hi"] - span["col_lo"] + 1)


def merged_top_left(reference: Column) -> Column:
    return F.upper(F.replace(F.split_part(reference, F.lit(":"), F.lit(1)), F.lit("$"), F.lit("")))


def overlaps(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    """Inclusive intervals share a point."""
    return (a_lo <= b_hi) & (a_hi >= b_lo)


def intersects(a: Column, b: Column) -> Column:
    return overlaps(a["row_lo"], a["row_hi"], b["row_lo"], b["row_hi"]) & overlaps(a["col_lo"], a["col_hi"], b["col_lo"], b["col_hi"])


def contains(outer: Column, inner: Column) -> Column:
    return (outer["row_lo"] <= inner["row_lo"]) & (inner["row_hi"] <= outer["row_hi"]) & (outer["col_lo"] <= inner["col_lo"]) & (inner["col_hi"] <= outer["col_hi"])
