"""Text functions: tokens, identifiers, display forms, typing of fields, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"
#: Unit words of a units row (fixed values).
UNITS = (
    "usd", "eur", "gbp", "jpy", "cad", "aud", "chf", "rmb", "cny", "mxn", "dollars", "euros", "pounds", "us dollars", "usd 000s", "euros 000s", "$", "€", "£", "¥", "₹", "%", "percent", "percentage", "bps", "pp", "kg", "g", "mg", "lb", "lbs", "oz", "t",
    "tonne", "tonnes", "mm", "cm", "m", "km", "in", "ft", "yd", "mi", "ea", "each", "pcs", "pieces", "units", "unit", "u", "count", "qty", "quantity", "hours", "hrs", "hr", "day", "days", "week", "weeks", "month", "months", "year", "years", "k", "bn",
    "thousand", "thousands", "million", "millions", "billion", "in thousands", "in millions", "in billions", "000s", "000", "per unit", "pct",
)
#: Words that begin a note (fixed values): whole words only.
NOTES = ("note", "notes", "assumption", "assumptions", "source", "sources", "legend", "disclaimer", "warning", "footnote", "footnotes", "data as of", "as of", "prepared by", "methodology", "commentary", "definition", "definitions")
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
NOTE = r"(?i)^\s*(" + "|".join(NOTES) + r")\b"


def tokens(text: Column) -> Column:
    """Distinct lower-cased word runs; none for null."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0)))


def slug(key: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(key)), r"[^a-z0-9_.!$:-]+", "_")


def node_id(workbook: Column, version: Column, kind: Column, key: Column) -> Column:
    return F.concat_ws(":", workbook, F.concat(F.lit("v"), version.cast("string")), kind, slug(key))


def version_key(workbook: Column, version: Column) -> Column:
    return F.concat_ws(":", workbook, F.concat(F.lit("v"), version.cast("string")))


def qualified(sheet: Column, a1: Column) -> Column:
    """Sheet!A1, the sheet quoted unless it is one word."""
    plain = F.regexp_like(sheet, F.lit(r"^[\p{L}\p{N}_]+$"))
    return F.concat(F.when(plain, sheet).otherwise(F.concat(F.lit("'"), F.replace(sheet, F.lit("'"), F.lit("''")), F.lit("'"))), F.lit("!"), a1)


def normalised_unit(text: Column) -> Column:
    return F.lower(F.btrim(F.trim(text), F.lit(".:")))


def is_unit(text: Column) -> Column:
    return normalised_unit(text).isin(*UNITS)


def is_note(text: Column) -> Column:
    return F.regexp_like(text, F.lit(NOTE))


def label(text: Column) -> Column:
    """A question's label: 2 to 60 characters with a letter, without a closing colon; else null."""
    clean = F.trim(F.rtrim(F.trim(text), F.lit(":")))
    return F.when(F.length(clean).between(2, 60) & F.regexp_like(clean, F.lit(r"\p{L}")), clean)


def cell_text(text: Column, limit: int) -> Column:
    """One line: white space collapsed, bars escaped, an ellipsis beyond the limit."""
    flat = F.replace(F.regexp_replace(F.trim(text), r"\s+", " "), F.lit("|"), F.lit("\\|"))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 1), F.lit("…"))).otherwise(flat)


def sheet_name_for(label_: Column) -> Column:
    stem = F.regexp_replace(F.regexp_replace(label_, r"^.*[/\\]", ""), r"\.[^.]*$", "")
    name = F.substring(F.regexp_replace(stem, r"[\[\]:*?/\\]", "_"), 1, 31)
    return F.when(name == "", F.lit("Sheet1")).otherwise(name)


def csv_kind(field: Column, comma_decimal: bool = False) -> Column:
    """Kind of a CSV field: empty, boolean, number or text. Integers with a leading zero are text."""
    stripped = F.trim(field)
    number = F.replace(stripped, F.lit(","), F.lit(".")) if comma_decimal else stripped
    return (
        F.when(stripped.isNull() | (stripped == ""), "empty")
        .when(F.upper(stripped).isin("TRUE", "FALSE"), "boolean")
        .when(F.regexp_like(stripped, F.lit(r"^[+-]?0\d+$")), "text")
        .when(F.regexp_like(number, F.lit(NUMBER)), "number")
        .otherwise("text")
    )


def csv_number(field: Column, comma_decimal: bool = False) -> Column:
    stripped = F.trim(field)
    number = F.replace(stripped, F.lit(","), F.lit(".")) if comma_decimal else stripped
    return F.when(csv_kind(field, comma_decimal) == "number", number.try_cast("double"))


def typed_input(raw: Column) -> Column:
    """struct<kind, num, str> of what a user types for a cell: 7% -> 0.07, 1,200 -> 1200, TRUE, error codes, else text."""
    text = F.trim(raw)
    percent = F.regexp_like(text, F.lit(r"^[+-]?[\d,]*\.?\d+%$"))
    plain = F.replace(text, F.lit(","), F.lit(""))
    number = F.when(percent, F.rtrim(plain, F.lit("%")).try_cast("double") / 100).when(F.regexp_like(plain, F.lit(NUMBER)), plain.try_cast("double"))
    kind = (
        F.when(text.isNull() | (text == ""), "empty").when(F.upper(text).isin("TRUE", "FALSE"), "boolean")
        .when(F.upper(text).isin("#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A"), "error").when(number.isNotNull(), "number").otherwise("text")
    )
    return F.struct(kind.alias("kind"), number.alias("num"), text.alias("str"))


def approx_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 3).cast("long")


def chunk_text(title: Column, content: Column) -> Column:
    return F.concat_ws("\n", title, content)


def header_path(levels: Column, default: Column) -> Column:
    path = F.array_join(F.filter(levels, lambda x: x.isNotNull() & (x != "")), " / ")
    return F.when(path == "", default).otherwise(path)


def display_number(value: Column) -> Column:
    """Integral numbers without a point."""
    return F.when((value == F.floor(value)) & (F.abs(value) < 1e15), value.cast("decimal(20,0)").cast("string")).otherwise(value.cast("string"))


def display(kind: Column, num: Column, text: Column, when: Column) -> Column:
    """A value in prose: TRUE and FALSE, whole numbers without a point, dates as ISO text, nothing for null."""
    day = F.date_format(when, "yyyy-MM-dd HH:mm:ss")
    return (
        F.when(kind == "boolean", F.when(num != 0, "TRUE").otherwise("FALSE")).when(kind == "number", display_number(num))
        .when(kind == "date", day).otherwise(F.coalesce(text, F.lit("")))
    )


def json_number(value: Column) -> Column:
    """Null for what JSON has no number for."""
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def name_label(name: Column, scope_sheet: Column) -> Column:
    """A defined name, and in brackets the sheet that it belongs to, if it doesn't belong to the workbook."""
    return F.when(scope_sheet.isNull(), name).otherwise(F.concat(name, F.lit(" (sheet "), scope_sheet, F.lit(")")))


def node_kind(node: Column) -> Column:
    """The kind in a node's id: its third part."""
    return F.split_part(node, F.lit(":"), F.lit(3))
