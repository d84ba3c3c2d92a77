"""Ledger cleaning: typing, defaults, business exclusions, splits and simple filters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demand_engine.functions.expressions import contains_any, normalize_sku, to_day, to_number

# Fixed values of the business rules.
DIMENSION_DEFAULTS = {
    "bodega": "Sin asignar",
    "documento": "Desconocido",
    "canal": "Sin canal",
    "cliente": "Sin cliente",
}
TRANSFER_TEXT = "Traspaso entre Almac"
GUIDES_SHORT = ("Guía de remisión - R",)
GUIDES_LONG = ("Guía de remisión - R", "GUIA ELECTRONICA-REM")
TARGET_SKUS = ("CER001", "CER005", "CEO001", "CEO006", "CERE002", "CER004", "CER008")


def coerce_types(df: DataFrame, numbers=("entrada", "salida", "saldo"), day: str = "fecha") -> DataFrame:
    """A3: quantities to double (unreadable -> 0), the day to date (unreadable -> null)."""
    typed = {c: to_number(c) for c in numbers if c in df.columns}
    if day in df.columns:
        typed[day] = to_day(day)
    return df.withColumns(typed)


def fill_dimension_defaults(df: DataFrame) -> DataFrame:
    """B1."""
    return df.na.fill({c: v for c, v in DIMENSION_DEFAULTS.items() if c in df.columns})


def exclude_transfers(df: DataFrame) -> DataFrame:
    """B2: transfers between warehouses leave; rows without document stay."""
    return df.where(~contains_any("documento", (TRANSFER_TEXT,)))


def mark_balanced_guides(df: DataFrame, patterns: tuple[str, ...] = GUIDES_SHORT, mark: str = "balanced") -> DataFrame:
    """Adds whether a row is a guide of a number whose guides move as much in as out.

    Only guide rows are shuffled (a left join on their number, which AQE can split when one number
    is hot); all other rows pass straight through. Rows without number are never balanced.
    """
    is_guide = contains_any("documento", patterns)
    guides = df.where(is_guide)
    balanced = (
        guides.where(F.col("numero").isNotNull())
        .groupBy("numero")
        .agg(F.sum("entrada").alias("_in"), F.sum("salida").alias("_out"))
        .where(F.round("_in", 6) == F.round("_out", 6))
        .select("numero", F.lit(True).alias(mark))
    )
    marked = guides.join(balanced, "numero", "left").withColumn(mark, F.coalesce(mark, F.lit(False)))
    return df.where(~is_guide).withColumn(mark, F.lit(False)).unionByName(marked)


def exclude_balanced_guides(df: DataFrame, patterns: tuple[str, ...] = GUIDES_SHORT) -> DataFrame:
    """Remove the guide rows of every number whose guides move as much in as out."""
    return mark_balanced_guides(df, patterns, "_balanced").where(~F.col("_balanced")).drop("_balanced")


def clean_movements(df: DataFrame, patterns: tuple[str, ...] = GUIDES_SHORT) -> DataFrame:
    """Defaults, then both exclusions (B1 -> B2 -> B3)."""
    return exclude_balanced_guides(exclude_transfers(fill_dimension_defaults(df)), patterns)


def sales(df: DataFrame) -> DataFrame:
    """Issues."""
    return df.where(F.col("salida") > 0)


def production(df: DataFrame) -> DataFrame:
    """Receipts."""
    return df.where(F.col("entrada") > 0)


def with_normalized_sku(df: DataFrame, column: str = "sku") -> DataFrame:
    """B5."""
    return df.withColumn(column, normalize_sku(column))


def only_skus(df: DataFrame, skus: tuple[str, ...] | list[str] = TARGET_SKUS) -> DataFrame:
    """Keep the given codes, written with or without blanks and quotes."""
    clean = [s.upper().replace("'", "").replace(" ", "") for s in skus]
    return df.where(normalize_sku("sku").isin(clean))


def since(df: DataFrame, day: dt.date | str, column: str = "week_start") -> DataFrame:
    """B7."""
    return df.where(F.col(column) >= F.lit(str(day)).cast("date"))


def last_n_weeks(series: DataFrame, n: int = 104, column: str = "week_start") -> DataFrame:
    """The last n rows of a weekly series; n = 0 keeps all."""
    return series.orderBy(F.desc(column)).limit(n) if n else series


def critical_only(df: DataFrame, selected: DataFrame | None) -> DataFrame:
    """Rows whose (normalised) SKU is selected; everything if there is no selection."""
    if selected is None:
        return df
    keys = selected.select(normalize_sku("sku").alias("_key")).distinct()
    return df.join(keys, normalize_sku(df["sku"]) == keys["_key"], "left_semi")


def drop_undated(df: DataFrame, column: str = "fecha") -> DataFrame:
    """B10."""
    return df.where(F.col(column).isNotNull())

