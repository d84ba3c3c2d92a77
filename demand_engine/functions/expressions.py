"""Column expressions used across operators. All stay inside Catalyst (no UDF)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_sku(c: Column | str) -> Column:
    """Upper-case, without quotes or any white space: ``"cer 001"`` and ``"'CER001"`` agree."""
    return F.upper(F.regexp_replace(col(c), r"[\s']", ""))


def week_start(c: Column | str) -> Column:
    """Monday of the week, in date arithmetic (independent of the session time zone)."""
    return F.date_sub(col(c), F.weekday(col(c)))


def iso_year(c: Column | str) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), col(c))


def to_number(c: Column | str) -> Column:
    """Text to double; what does not parse, or is missing, counts as 0."""
    return F.coalesce(col(c).try_cast("double"), F.lit(0.0))


def to_day(c: Column | str) -> Column:
    """Text to date; what does not parse becomes null."""
    return col(c).try_cast("timestamp").cast("date")


def ratio(num: Column, den: Column, otherwise: float | None = None) -> Column:
    """``num / den``; a zero denominator gives ``otherwise`` instead of an error or infinity."""
    value = F.try_divide(num, den)
    return value if otherwise is None else F.coalesce(value, F.lit(float(otherwise)))


def half_up(c: Column | str, digits: int = 0) -> Column:
    """Round half towards +infinity, also for negatives."""
    scale = 10.0**digits
    return F.floor(col(c) * scale + 0.5) / scale


def contains_any(c: Column | str, fragments: tuple[str, ...]) -> Column:
    """Case-insensitive 'contains one of'; null counts as no."""
    text = F.lower(col(c))
    hits = [text.contains(f.lower()) for f in fragments]
    return F.coalesce(reduce(lambda a, b: a | b, hits), F.lit(False))


def beside(df: DataFrame, *one_row: DataFrame) -> DataFrame:
    """``df`` with the columns of one-row results added to each of its rows (scalar subqueries)."""
    out = df
    for i, other in enumerate(one_row):
        name = f"_beside_{i}"
        out = out.withColumn(name, other.select(F.struct("*")).scalar())
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[f"_beside_{i}.*" for i in range(len(one_row))])


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def magnitude_bucket(c: Column | str, per_octave: int = 64) -> Column:
    """Order-preserving bucket of a non-negative number: geometric, about 1 % wide.

    A pure function of the value, so two evaluations always agree; used to split a long ordering
    into many small ones. 0 and below fall into one lowest bucket.
    """
    value = col(c)
    bucket = F.when(value > 0, F.floor(F.log2(value) * per_octave).cast("int"))
    return F.coalesce(bucket, F.lit(-1_000_000))
