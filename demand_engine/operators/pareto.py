"""Pareto analysis of sales."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demand_engine.functions.expressions import ratio
from demand_engine.functions.ordering import ranked_running_total


def pareto_curve(df: DataFrame, levels: tuple[int, ...] = (80, 90)) -> DataFrame:
    """Rank and cumulative share per SKU, and per level whether the SKU is selected.

    A SKU is selected while the cumulative share stays within the level; the first SKU always is,
    unless nothing was sold at all.
    """
    totals = df.where(F.col("sku").isNotNull()).groupBy("sku").agg(F.sum("salida").alias("total"))
    ranked = ranked_running_total(totals, "total", "sku", "rank", "_running", "_all")
    curve = ranked.withColumn(
        "cum_pct", ratio(F.col("_running") * F.lit(100.0), F.col("_all"))
    )
    for level in levels:
        chosen = (F.col("cum_pct") <= level) | (F.col("rank") == 1)
        curve = curve.withColumn(f"in_{level}", F.coalesce(chosen & (F.col("_all") > 0), F.lit(False)))
    return curve.select("sku", "rank", "total", "cum_pct", *[f"in_{level}" for level in levels])


def pareto_cut(curve: DataFrame, levels: tuple[int, ...] = (80, 90)) -> DataFrame:
    """How many SKUs each level selects."""
    return curve.agg(
        F.count("*").alias("products"),
        *[F.count_if(f"in_{level}").alias(f"products_{level}") for level in levels],
    )


def pareto_summary(curve: DataFrame, levels: tuple[int, ...] = (80, 90)) -> DataFrame:
    """Counts, coverage and the critical SKUs' share (null where nothing was sold).

    The critical SKUs themselves stay rows (``curve.where("in_80")``): their number grows with the
    catalogue.
    """
    critical = F.sum(F.when(F.col(f"in_{levels[0]}"), F.col("total"))).alias("critical_total")
    out = curve.agg(
        F.count("*").alias("products"),
        *[F.count_if(f"in_{level}").alias(f"products_{level}") for level in levels],
        critical,
        F.sum("total").alias("_all"),
    )
    for level in levels:
        share = ratio(F.col(f"products_{level}") * F.lit(100.0), F.col("products"))
        out = out.withColumn(f"coverage_{level}", F.round(share, 1))
    return out.withColumn(
        "critical_pct", F.round(ratio(F.col("critical_total") * F.lit(100.0), F.col("_all")), 1)
    ).drop("_all")


def pareto_listing(sold: DataFrame, selected: DataFrame) -> DataFrame:
    """Code, description, sales and running share of the selected SKUs. ``sold``: D1."""
    return sold.join(selected.select("sku").distinct(), "sku", "left_semi").select(
        "sku", "descripcion", F.col("salida_total").alias("ventas"), F.col("acumulado_pct").alias("pct")
    )
