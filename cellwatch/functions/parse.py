"""Text to numbers, lists and epoch seconds.

Every function takes and returns a ``Column`` and never raises on bad input:
what cannot be read becomes null and the caller decides whether that skips a
row or fails an order.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F, types as T

WHITESPACE = " \t\n\r\f\x0b"

# Number spellings the JVM reads but the data contract does not: hexadecimal
# digits and the type suffixes of Java literals ("1d", "2.f").
JAVA_ONLY_NUMBER = r"[dDxX]|[0-9.][fF]"

# Fixed pattern: date and time with an optional fraction of one to six digits.
TIMESTAMP_TEXT = r"^\d{4}-\d\d?-\d\d? \d\d?:\d\d?:\d\d?(\.\d{1,6})?$"


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once however often the body uses it.

    A one-item array turns the value into a lambda variable; the optimizer would
    otherwise inline a costly expression at every use.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def has_null(values: Column) -> Column:
    return F.exists(values, lambda x: x.isNull())


def whole(values: Column) -> Column:
    """The array itself, or null when any item is null."""
    return bind(values, lambda a: F.when(~has_null(a), a))


def to_double(col: Column, dtype: T.DataType | None = None) -> Column:
    """Number, or null when the text is not one."""
    if isinstance(dtype, T.ArrayType):
        return F.lit(None).cast("double")
    if dtype is None or isinstance(dtype, T.StringType):
        return F.when(~foreign_number(col), col.try_cast("double"))
    return col.try_cast("double")


def parse_list(col: Column, dtype: T.DataType | None = None) -> Column:
    """``"[a, b, …]"`` to an array of doubles.

    Brackets at both ends are stripped, empty items dropped, and one unreadable
    item makes the whole list null.  Array columns are cast item by item under
    the same rule.
    """
    if isinstance(dtype, T.ArrayType):
        return whole(col.try_cast("array<double>"))
    if dtype is not None and not isinstance(dtype, T.StringType):
        return F.lit(None).cast("array<double>")
    items = F.transform(F.split(F.trim(col, F.lit("[]")), ","), lambda x: F.trim(x, F.lit(WHITESPACE)))
    filled = F.filter(items, lambda x: x != "")
    return F.when(~foreign_number(col), whole(filled.try_cast("array<double>")))


def foreign_number(col: Column) -> Column:
    """Text with a number spelling that only the JVM reads.

    Such a spelling needs one of a few letters, which hardly any text has, so
    the pattern is tried only where one occurs.
    """
    letters = reduce(or_, (col.contains(letter) for letter in "dDfFxX"))
    return letters & col.rlike(JAVA_ONLY_NUMBER)


def with_lists(df: DataFrame, lists: dict[str, str]) -> DataFrame:
    """Add ``parse_list`` of columns, by the shortest way for ordinary texts.

    Texts of the form ``[a, b, …]`` with numbers throughout need only a split
    and a cast, both in generated code.  All other texts go through
    ``parse_list``.
    """
    quick, columns = {}, {}
    for name, source in lists.items():
        col, dtype = F.col(source), df.schema[source].dataType
        if not isinstance(dtype, T.StringType):
            columns[name] = parse_list(col, dtype)
            continue
        inner = F.substring(col, F.lit(2), F.length(col) - 2)
        bracketed = col.startswith("[") & col.endswith("]") & (F.length(col) > 2) & ~foreign_number(col)
        quick[f"{name}_quick"] = F.when(bracketed, F.split(inner, ",").try_cast("array<double>"))
        cells = F.col(f"{name}_quick")
        # Looking for any value answers null, not false, when an item is null.
        complete = F.array_contains(cells, F.lit(-1e300)).eqNullSafe(F.lit(False))
        columns[name] = F.when(complete, cells).otherwise(parse_list(col, dtype))
    return df.withColumns(quick).withColumns(columns).drop(*quick)


def pick_extreme(values: Column, largest: bool) -> Column:
    """Largest or smallest item, where a leading NaN wins and later NaNs lose."""
    best = highest(values) if largest else F.array_min(values)
    return F.when(F.isnan(F.get(values, F.lit(0))), F.lit(float("nan"))).otherwise(best)


def highest(values: Column) -> Column:
    """Largest item that is a number; NaN sorts above all numbers, so it is set aside."""
    real = F.filter(values, lambda x: ~F.isnan(x))
    top = F.array_max(values)
    return F.when(~F.isnan(top), top).otherwise(F.coalesce(F.array_max(real), F.lit(float("nan"))))


def scalar_or_list(col: Column, dtype: T.DataType, largest: bool) -> Column:
    """A number, or the extreme of a list; null when there is neither."""
    if isinstance(dtype, (T.StringType, T.ArrayType)):
        return pick_extreme(parse_list(col, dtype), largest)
    return to_double(col, dtype)


def epoch_of_text(col: Column) -> Column:
    """Epoch seconds of one time text in the session time zone; the fraction is dropped."""
    return F.when(col.rlike(TIMESTAMP_TEXT), F.unix_timestamp(col.try_cast("timestamp")))


def epoch_list(col: Column) -> Column:
    """Comma list of time texts to an array of epoch seconds; one bad item makes it null."""
    return whole(F.transform(F.split(F.trim(col, F.lit(",")), ","), epoch_of_text))


def epoch_seconds(col: Column, dtype: T.DataType, listed: Column | None = None) -> Column:
    """Epoch seconds of a timestamp or text column.

    ``listed`` marks the rows on which a comma list is accepted, provided it
    holds exactly one time.
    """
    if not isinstance(dtype, T.StringType):
        return F.unix_timestamp(col.cast("timestamp"))
    if listed is None:
        return epoch_of_text(col)
    stamps = epoch_list(col)
    return F.when(listed, F.when(F.size(stamps) == 1, F.get(stamps, F.lit(0)))).otherwise(epoch_of_text(col))
