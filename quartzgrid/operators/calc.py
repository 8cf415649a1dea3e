"""Recalculation in DataFrames: spreadsheet arithmetic with error values, linear recurrences, dirty marking, saved-value checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quartzgrid.operators.diff import differs


def number(value: Column, error: Column | None = None) -> Column:
    """struct<num, err>; an empty operand is 0."""
    return F.struct(F.coalesce(value.cast("double"), F.lit(0.0)).alias("num"), (error if error is not None else F.lit(None).cast("string")).alias("err"))


def _result(num: Column, err: Column) -> Column:
    overflow = F.isnan(num) | (F.abs(num) == float("inf"))
    err = F.coalesce(err, F.when(overflow, F.lit("#NUM!")))
    return F.struct(F.when(err.isNull(), num).alias("num"), err.alias("err"))


def binary(operator: str, a: Column, b: Column) -> Column:
    """The first error met wins; x/0 is #DIV/0!, 0^0 and a negative number to a fractional power #NUM!, 0^negative #DIV/0!."""
    x, y = a["num"], b["num"]
    err = F.coalesce(a["err"], b["err"])
    if operator == "/":
        return _result(F.try_divide(x, y), F.coalesce(err, F.when(y == 0, F.lit("#DIV/0!"))))
    if operator == "^":
        own = F.when((x == 0) & (y == 0), F.lit("#NUM!")).when((x == 0) & (y < 0), F.lit("#DIV/0!")).when((x < 0) & (y != F.floor(y)), F.lit("#NUM!"))
        return _result(F.when(own.isNull(), F.pow(x, y)).otherwise(F.lit(0.0)), F.coalesce(err, own))
    return _result({"+": x + y, "-": x - y, "*": x * y}[operator], err)


def percent(a: Column) -> Column:
    return _result(a["num"] / 100, a["err"])


def negate(a: Column) -> Column:
    return _result(-a["num"], a["err"])


def running_balance(df: DataFrame, keys: list[str], order: str, amount: Column, opening: Column) -> DataFrame:
    """The recurrence X_n = X_(n-1) + amount_n as a prefix sum: depth doesn't matter."""
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("balance", opening + F.sum(amount).over(window))


def provenance(changed: Column, is_input: Column, dirty: Column, computable: Column) -> Column:
    """changed before input before saved before recalculated; what can't be computed is unknown, not null."""
    return F.when(changed, "changed").when(is_input, "input").when(~dirty, "saved").when(computable, "recalculated").otherwise("unknown")


def mismatches(df: DataFrame, saved: str, computed: str) -> DataFrame:
    return df.where(differs(F.col(saved), F.col(computed)))
