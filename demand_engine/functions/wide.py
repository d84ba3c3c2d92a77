"""Wide tables for reading: one column per value of a column, the values taken from the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 500  # columns of one wide table


def names_of(df: DataFrame, column: str) -> list[str]:
    """The distinct values, in order. They become column names, so they have to fit the driver."""
    return [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]


def tiles(df: DataFrame, column: str, size: int = TILE) -> list[list[str]]:
    """The values cut into lists of up to ``size``: a catalogue too wide for one table is shown in several, side by side."""
    names = names_of(df, column)
    return [names[i: i + size] for i in range(0, len(names), size)]


def wide(df: DataFrame, key: str, column: str, value: Column, names: list[str] | None = None) -> DataFrame:
    """``key`` and a column of ``value`` for each name (default: all there are, found in a first pass)."""
    return df.groupBy(key).pivot(column, names_of(df, column) if names is None else names).agg(value)
