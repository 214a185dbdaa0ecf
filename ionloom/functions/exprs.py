"""Small column helpers shared by the expression modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: first decimal number in a text field.
NUMBER = r"(-?\d+[.,]?\d*(?:[Ee][+-]?\d+)?)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A plain column reference would be inlined into lambda bodies and re-evaluated for every
    array element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns that are evaluated once per row, whatever reads them.

    As output of a generator they are not merged into later projections, nor into a filter that would
    otherwise be pushed below them and evaluate them again.
    """
    own = [c for c in df.columns if c not in columns]
    return df.select(*own, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def blank_to_null(col: Column) -> Column:
    return F.when(col != "", col)


def matches(col: Column, pattern: str) -> Column:
    """``rlike`` that answers false for NULL."""
    return F.coalesce(col.rlike(pattern), F.lit(False))


def group_or_null(col: Column, pattern: str, group: int = 1) -> Column:
    return let(F.regexp_extract(col, pattern, group), blank_to_null)


def to_number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def first_number(col: Column) -> Column:
    """First number found in a text, decimal comma allowed; NULL when there is none."""
    return to_number(group_or_null(col, NUMBER))


def number_text(col: Column, digits: int = 8) -> Column:
    """Fixed-point text without trailing zeros or exponents."""
    return F.when(
        col.isNotNull(),
        F.regexp_replace(F.format_string(f"%.{digits}f", col), r"\.?0+$", ""),
    )
