"""Outlier treatment per SKU."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demand_engine.functions.expressions import beside
from demand_engine.functions.ordering import exact_quantiles

MIN_POSITIVE = 4  # fewer positive movements than this: the SKU is left as it is


def cap_p99(df: DataFrame, columns: tuple[str, ...] = ("salida", "entrada"), p: float = 0.99) -> DataFrame:
    """Cap quantities above the SKU's p-quantile of positive quantities.

    Adds ``<column>_capped`` (boolean). Caps are one row per SKU; the join lets AQE broadcast them
    when they are small and split a hot SKU when they are not.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("m"), F.col(c).alias("x")) for c in columns]))
    measured = df.where(F.col("sku").isNotNull()).select("sku", pairs.alias("_p")).select("sku", "_p.m", "_p.x")
    limits = exact_quantiles(measured, ["sku", "m"], "x", {"cap": p}).where(F.col("n") >= MIN_POSITIVE)
    caps = limits.groupBy("sku").agg(*[F.max(F.when(F.col("m") == c, F.col("cap"))).alias(f"_cap_{c}") for c in columns])
    out = df.join(caps, "sku", "left")
    for c in columns:
        over = F.coalesce(F.col(c) > F.col(f"_cap_{c}"), F.lit(False))
        out = out.withColumns(
            {f"{c}_capped": over, c: F.when(over, F.col(f"_cap_{c}")).otherwise(F.col(c))}
        )
    return out.drop(*[f"_cap_{c}" for c in columns])


def replace_iqr_outliers(df: DataFrame, column: str = "salida") -> DataFrame:
    """Positive values outside [max(0, Q1-1.5 IQR), Q3+1.5 IQR] become the SKU's median.

    Adds ``replaced`` (boolean).
    """
    q = exact_quantiles(df, ["sku"], column, {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75}).where(F.col("n") >= MIN_POSITIVE)
    iqr = F.col("_q3") - F.col("_q1")
    bounds = q.select(
        "sku",
        F.col("_q2").alias("_median"),
        F.greatest(F.lit(0.0), F.col("_q1") - 1.5 * iqr).alias("_low"),
        (F.col("_q3") + 1.5 * iqr).alias("_high"),
    )
    x: Column = F.col(column)
    outside = (x > 0) & ((x > F.col("_high")) | (x < F.col("_low")))
    return (
        df.join(bounds, "sku", "left")
        .withColumn("replaced", F.coalesce(outside, F.lit(False)))
        .withColumn(column, F.when(F.col("replaced"), F.col("_median")).otherwise(x))
        .drop("_median", "_low", "_high")
    )


def outlier_report(replaced: DataFrame) -> DataFrame:
    """Replaced rows per SKU (only where any) and the total, as the row with ``sku = null``."""
    return (
        replaced.where("replaced")
        .rollup("sku")
        .agg(F.count("*").alias("outliers"))
    )


def cleaning_summary(raw: DataFrame, capped: DataFrame, top: DataFrame) -> DataFrame:
    """C4: one row of counts of the cleaning stage. ``top``: result of ``top_products``."""
    top_keys = top.select("sku", F.lit(1).alias("_top"))
    kept = capped.join(top_keys, "sku", "left")
    sold = F.col("salida") > 0
    counts = kept.agg(
        F.count("*").alias("clean_rows"),
        F.count_if(sold).alias("sale_rows"),
        F.count_if(sold & F.col("_top").isNotNull()).alias("top_rows"),
        (F.count_if("salida_capped") + F.count_if("entrada_capped")).alias("capped"),
        F.count_distinct(F.when(sold, F.col("sku"))).alias("products"),
    )
    top_list = top.agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct((-F.col("salida_total")).alias("t"), F.col("sku").alias("s")))),
                lambda r: r["s"],
            ),
            ",",
        ).alias("top_products")
    )
    return beside(raw.agg(F.count("*").alias("raw_rows")), counts, top_list)
