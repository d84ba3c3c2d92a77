"""Product, warehouse, channel and time profiles of the cleaned ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demand_engine.functions.expressions import beside, week_start
from demand_engine.functions.ordering import modes, ranked_running_total
from demand_engine.operators.cleaning import drop_undated, production, sales


def _profile(df: DataFrame, quantity: str, prefix: str, order: list[str]) -> DataFrame:
    """Statistics of one quantity per SKU with the running share of the total, largest first."""
    stats = df.where(F.col("sku").isNotNull()).groupBy("sku").agg(
        F.count(quantity).alias("num_transacciones"),
        F.sum(quantity).alias(f"{prefix}_total"),
        F.mean(quantity).alias(f"{prefix}_promedio"),
        F.stddev_samp(quantity).alias(f"{prefix}_std"),
        F.min(quantity).alias(f"{prefix}_min"),
        F.max(quantity).alias(f"{prefix}_max"),
        F.min_by("descripcion", F.when(F.col("descripcion").isNotNull(), F.struct(*order))).alias("descripcion"),
    )
    ranked = ranked_running_total(stats, f"{prefix}_total", "sku", "rank", "_running", "_all")
    return ranked.withColumn("acumulado_pct", 100 * F.col("_running") / F.col("_all")).drop("_running", "_all")


def sales_by_product(df: DataFrame, order: list[str]) -> DataFrame:
    """D1. ``order``: columns that put a SKU's movements in sequence (first description wins)."""
    return _profile(sales(df), "salida", "salida", order)


def production_by_product(df: DataFrame, order: list[str]) -> DataFrame:
    """D2."""
    return _profile(production(df), "entrada", "entrada", order)


def stock_by_product(df: DataFrame) -> DataFrame:
    """D3: balance statistics and the most frequent warehouse (ties: smallest name)."""
    df = df.where(F.col("sku").isNotNull())
    stats = df.groupBy("sku").agg(
        F.min("saldo").alias("stock_min"),
        F.mean("saldo").alias("stock_promedio"),
        F.max("saldo").alias("stock_max"),
        F.stddev_samp("saldo").alias("stock_std"),
        F.count("saldo").alias("num_registros"),
    )
    main = modes(df, ["sku"], ["bodega"]).withColumnRenamed("bodega", "bodega_principal")
    return stats.join(main, "sku", "left").fillna("Unknown", ["bodega_principal"])


def inventory_rotation(sold: DataFrame, stock: DataFrame) -> DataFrame:
    """Total sales over mean stock; a mean of 0 counts as 1. Inputs: D1 and D3."""
    mean = F.col("stock_promedio")
    return (
        sold.select("sku", "salida_total", "descripcion")
        .join(stock.select("sku", "stock_promedio"), "sku", "left")
        .withColumn("rotacion", F.col("salida_total") / F.when(mean == 0, 1.0).otherwise(mean))
    )


def _sales_by(df: DataFrame, key: str) -> DataFrame:
    return (
        sales(df)
        .groupBy(key)
        .agg(
            F.count("salida").alias("num_transacciones"),
            F.sum("salida").alias("salida_total"),
            F.count_distinct("sku").alias("productos_unicos"),
        )
    )


def sales_by_warehouse(df: DataFrame) -> DataFrame:
    """D5."""
    return _sales_by(df, "bodega")


def sales_by_channel(df: DataFrame) -> DataFrame:
    """D6."""
    return _sales_by(df, "canal")


def monthly_trend(df: DataFrame) -> DataFrame:
    """D7."""
    return (
        drop_undated(sales(df))
        .groupBy(F.year("fecha").alias("anio"), F.month("fecha").alias("mes"))
        .agg(F.count("salida").alias("num_transacciones"), F.sum("salida").alias("salida_total"))
        .withColumn("anio_mes", F.concat(F.col("anio"), F.lit("-"), F.lpad(F.col("mes").cast("string"), 2, "0")))
    )


def top_products(df: DataFrame, n: int = 20) -> DataFrame:
    """The n best sellers with rounded statistics (ties: smallest SKU)."""
    stats = (
        sales(df)
        .where(F.col("sku").isNotNull())
        .groupBy("sku")
        .agg(
            F.count("salida").alias("transacciones"),
            F.round(F.sum("salida"), 2).alias("salida_total"),
            F.round(F.mean("salida"), 2).alias("salida_promedio"),
            F.round(F.stddev_samp("salida"), 2).alias("salida_std"),
            F.round(F.min("salida"), 2).alias("salida_min"),
            F.round(F.max("salida"), 2).alias("salida_max"),
        )
    )
    return stats.orderBy(F.desc("salida_total"), "sku").limit(n)


def restrict_to(df: DataFrame, products: DataFrame) -> DataFrame:
    """The movements of the given products."""
    return df.join(products.select("sku").distinct(), "sku", "left_semi")


def run_summary(df: DataFrame, level: float = 80.0) -> DataFrame:
    """One row on the cleaned ledger. The Pareto count here has no floor of one."""
    base = df.agg(
        F.count("*").alias("registros_totales"),
        F.min("fecha").alias("fecha_min"),
        F.max("fecha").alias("fecha_max"),
        F.count_distinct("sku").alias("productos_totales"),
    )
    weeks = drop_undated(df).agg(F.count_distinct(week_start("fecha")).alias("semanas_analizadas"))
    totals = sales(df).where(F.col("sku").isNotNull()).groupBy("sku").agg(F.sum("salida").alias("total"))
    pareto = ranked_running_total(totals, "total", "sku").agg(
        F.count("*").alias("productos_con_ventas"),
        F.count_if(100 * F.col("running") / F.col("total_all") <= level).alias("productos_pareto"),
    )
    return beside(base, weeks, pareto)


