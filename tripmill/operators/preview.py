"""Raw rows for a look at the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def raw_preview(source: DataFrame, limit: int = 30) -> DataFrame:
    """Some rows, unfiltered and in no order: reads as little as it can."""
    return source.limit(limit)


def rows_of_the_first(source: DataFrame, leading: dict[str, Column], limit: int = 30) -> DataFrame:
    """The rows among which the first `limit` in any order that begins with `leading`
    are: those whose leading values are among the first `limit`, ties and all."""
    order = [F.col(name).asc_nulls_last() for name in leading]
    first = source.select(*(value.alias(name) for name, value in leading.items())).orderBy(*order).limit(limit).distinct()
    same = [value.eqNullSafe(first[name]) for name, value in leading.items()]
    # `limit` rows at most.
    return source.join(F.broadcast(first), same, "left_semi")


def first_rows(source: DataFrame, limit: int = 30) -> DataFrame:
    """The rows that come first in the order of all columns, NULLs last; the
    repeatable preview, at the price of a full scan."""
    order = [F.col(name).asc_nulls_last() for name in source.columns]
    return source.orderBy(*order).limit(limit)
