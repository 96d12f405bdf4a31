"""Lenient parsing of numbers, dates and flags as column expressions.

Missing is always NULL, never NaN, and a missing value makes a predicate false.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T


def ref(name: str) -> Column:
    """Reference a column whose name may hold spaces, dots or commas."""
    return F.col(f"`{name.replace('`', '``')}`")


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def no_nan(value: Column) -> Column:
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def number_sql(df: DataFrame, name: str, fill: float | None = None) -> str:
    """SQL text of a column as double; unreadable or absent becomes NULL, or ``fill``."""
    if name not in df.columns:
        value = "CAST(NULL AS DOUBLE)"
    elif is_text(df, name):
        value = f"nanvl(try_cast(trim({quoted(name)}) AS DOUBLE), CAST(NULL AS DOUBLE))"
    elif isinstance(df.schema[name].dataType, T.FractionalType):
        value = f"nanvl(CAST({quoted(name)} AS DOUBLE), CAST(NULL AS DOUBLE))"
    else:
        value = f"CAST({quoted(name)} AS DOUBLE)"
    return value if fill is None else f"coalesce({value}, {float(fill)!r}D)"


def number(df: DataFrame, name: str, fill: float | None = None) -> Column:
    """The same as a column."""
    return F.expr(number_sql(df, name, fill))


def decimal_comma(value: Column) -> Column:
    """Text such as ``" 1 234,5"`` to double."""
    text = F.regexp_replace(F.regexp_replace(value.cast("string"), r"\s", ""), ",", ".")
    return no_nan(text.try_cast("double"))


def lenient_int(value: Column) -> Column:
    """Decimal-comma text to a whole number, halves to even."""
    return F.bround(decimal_comma(value), 0).cast("bigint")


_PARTS = {"ymd": ((1, 4), (5, 2), (7, 2)), "dmy": ((5, 4), (3, 2), (1, 2))}


def _from_eight_sql(text: str, order: str) -> str:
    parts = ", ".join(f"substring({text}, {at}, {n})" for at, n in _PARTS[order])
    return f"try_cast(concat_ws('-', {parts}) AS DATE)"


def _from_eight(text: Column, order: str) -> Column:
    parts = [F.substring(text, at, n) for at, n in _PARTS[order]]
    return F.concat_ws("-", *parts).try_cast("date")


def compact_date_sql(df: DataFrame, name: str, order: str) -> str:
    """Digits of a ``ymd`` or ``dmy`` value to a date: pad to eight, keep the first eight."""
    if name not in df.columns:
        return "CAST(NULL AS DATE)"
    kind = df.schema[name].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return f"CAST({quoted(name)} AS DATE)"
    whole = f"CAST({quoted(name)} AS BIGINT)" if isinstance(kind, T.NumericType) else quoted(name)
    digits = f"regexp_replace(CAST({whole} AS STRING), '[^0-9]', '')"
    eight = f"CASE WHEN length({digits}) < 8 THEN lpad({digits}, 8, '0') ELSE substring({digits}, 1, 8) END"
    return (
        f"CASE WHEN length({digits}) > 0 AND {eight} <> '00000000' "
        f"THEN {_from_eight_sql('(' + eight + ')', order)} END"
    )


def compact_date(df: DataFrame, name: str, order: str) -> Column:
    return F.expr(compact_date_sql(df, name, order))


def date_by_number(value: Column, order: str) -> Column:
    """The variant that reads the text as a number first and pads to eight digits."""
    digits = lenient_int(value).cast("string")
    eight = F.when(F.length(digits) < 8, F.lpad(digits, 8, "0")).otherwise(digits)
    return F.when(F.length(eight) == 8, _from_eight(eight, order))


def date_strict_eight(value: Column) -> Column:
    """``ymd`` only when the number has exactly eight digits already."""
    digits = decimal_comma(value).cast("bigint").cast("string")
    return F.when(F.length(digits) == 8, _from_eight(digits, "ymd"))


def date_before_dot(value: Column) -> Column:
    """``dmy`` from the text before the first dot, padded to eight."""
    head = F.substring_index(F.trim(value.cast("string")), ".", 1)
    eight = F.when(F.length(head) < 8, F.lpad(head, 8, "0")).otherwise(head)
    return F.when(eight.rlike(r"^\d{8}$"), _from_eight(eight, "dmy"))


def true_or_false(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def flag(condition: Column) -> Column:
    return true_or_false(condition).cast("int")


def target(df: DataFrame, label: str = "PAR", positive: tuple[int, ...] = (1, 2)) -> Column:
    """1 where the label is one of the positive codes, else 0 (NULL too)."""
    return flag(number(df, label).isin(*[float(p) for p in positive]))


def all_zero_sql(df: DataFrame, names: list[str]) -> str:
    """Every present column is 0 or missing; no column present is false."""
    present = [n for n in names if n in df.columns]
    return " AND ".join(f"{number_sql(df, n, 0.0)} = 0" for n in present) or "false"


def all_zero(df: DataFrame, names: list[str]) -> Column:
    return F.expr(all_zero_sql(df, names))


def indicator_sql(df: DataFrame, name: str) -> str:
    """A flag-like column as true or false; missing is false."""
    if name not in df.columns:
        return "false"
    if isinstance(df.schema[name].dataType, T.BooleanType):
        return f"coalesce({quoted(name)}, false)"
    return f"coalesce({number_sql(df, name)} > 0, false)"


def indicator(df: DataFrame, name: str) -> Column:
    return F.expr(indicator_sql(df, name))


def clip(value: Column, low: float, high: float) -> Column:
    """NULL stays NULL; ``least``/``greatest`` alone would skip it."""
    bounded = F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))
    return F.when(value.isNotNull(), bounded)


def total(values: list[Column]) -> Column:
    return reduce(add, values)
