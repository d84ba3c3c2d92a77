"""Sheet material: consumption, gaps, costs, savings (Y10-Y19, A12 tables)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demand_engine.functions.expressions import beside, half_up, ratio
from demand_engine.functions.wide import wide
from demand_engine.operators.planning import clamp_safety_weeks, month_label

# Default prices per sheet type, units per sheet and sheets per unit of each SKU.
SHEET_PRICES = {"0.75": 129.95, "1.20": 201.63}
SKU_YIELDS = {
    "CER001": ("0.75", 141),
    "CER005": ("0.75", 141),
    "CEO001": ("0.75", 113),
    "CEO006": ("0.75", 113),
    "CER008": ("1.20", 115),
    "CER004": ("1.20", 141),
    "CERE002": ("1.20", 141),
}
SHEETS_PER_UNIT = {
    "CER001": (0.007, 129.95),
    "CER005": (0.007, 129.95),
    "CER004": (0.007, 201.63),
    "CERE002": (0.007, 201.63),
    "CEO001": (0.009, 129.95),
    "CEO006": (0.009, 129.95),
    "CER008": (0.009, 201.63),
}
# Extra cost of over-production, percent of its material cost.
EXTRA_RATES = {
    "mano_obra": 18,
    "transporte": 6,
    "energia": 5,
    "almacenamiento": 8,
    "depreciacion": 3,
    "oportunidad": 10,
    "deterioro": 2,
}


def sheet_config(spark: SparkSession, config: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(prices by type, yield by SKU) of a configuration with both maps; the default without one."""
    if config is None:
        prices, skus = SHEET_PRICES, SKU_YIELDS
    elif not config.get("precios") or not config.get("skus"):
        raise ValueError("Invalid config: must include precios and skus")
    else:
        prices = config["precios"]
        skus = {k: (v["tipo"], v["prod_por_plancha"]) for k, v in config["skus"].items()}
    return (
        spark.createDataFrame([(t, float(p)) for t, p in prices.items()], "tipo string, precio double"),
        spark.createDataFrame([(s, t, int(y)) for s, (t, y) in skus.items()], "sku string, tipo string, prod_por_plancha int"),
    )


def sheets_per_unit(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(s, u, p) for s, (u, p) in SHEETS_PER_UNIT.items()], "sku string, sheets_per_unit double, price double"
    )


def extra_rates(spark: SparkSession, rates: dict[str, float] | None = None) -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in (rates or EXTRA_RATES).items()], "key string, pct double")


def unit_cost(prices: DataFrame, yields: DataFrame) -> DataFrame:
    """Price, sheets and cost per unit of each configured SKU. There are as many prices as sheet types: a few rows."""
    return yields.join(F.broadcast(prices), "tipo").withColumn("unit_cost", F.col("precio") / F.col("prod_por_plancha"))


def sheet_consumption(weekly: DataFrame, config: DataFrame) -> DataFrame:
    """Sheets behind sales and production. ``config``: sku, sheets_per_unit, price."""
    return weekly.join(config.select("sku", "sheets_per_unit"), "sku").select(
        "sku", "week_start", "sales", "production",
        (F.col("sales") * F.col("sheets_per_unit")).alias("sheets_sales"),
        (F.col("production") * F.col("sheets_per_unit")).alias("sheets_production"),
    )


def sheet_gap(consumption: DataFrame) -> DataFrame:
    """Y11."""
    return consumption.withColumn("sheets_gap", F.col("sheets_production") - F.col("sheets_sales"))


def sheet_weekly_total(consumption: DataFrame) -> DataFrame:
    """Y12."""
    return consumption.groupBy("week_start").agg(
        F.sum("sheets_sales").alias("sheets_sales"), F.sum("sheets_production").alias("sheets_production")
    )


def sheet_cost_summary(weekly: DataFrame, config: DataFrame) -> DataFrame:
    """Totals, sheets, gap, costs, potential saving and efficiency (0 without production)."""
    totals = weekly.groupBy("sku").agg(F.sum("production").alias("_p"), F.sum("sales").alias("_s")).join(config, "sku")
    made, sold = F.col("_p") * F.col("sheets_per_unit"), F.col("_s") * F.col("sheets_per_unit")
    efficiency = F.when(F.col("_p") > 0, F.round(ratio(F.col("_s"), F.col("_p")) * 100, 1)).otherwise(0.0)
    return totals.select(
        "sku",
        F.col("_p").cast("long").alias("produccion_total"),
        F.col("_s").cast("long").alias("ventas_total"),
        F.round(made, 2).alias("planchas_produccion"),
        F.round(sold, 2).alias("planchas_ventas"),
        F.round(made - sold, 2).alias("planchas_gap"),
        F.round(made * F.col("price"), 2).alias("costo_produccion"),
        F.round(sold * F.col("price"), 2).alias("costo_ventas"),
        F.round((made - sold) * F.col("price"), 2).alias("ahorro_potencial"),
        efficiency.alias("eficiencia"),
    )


def sheet_totals(summary: DataFrame) -> DataFrame:
    """Y14."""
    return summary.select("sku", "planchas_produccion", "planchas_ventas", "planchas_gap")


def plan_cost(plan: DataFrame, costs: DataFrame, horizon: int = 52) -> DataFrame:
    """Y15 per (SKU, week): units, sheets and cost of the plan. ``costs``: ``unit_cost``."""
    return plan.where(F.col("h") <= horizon).join(costs, "sku").select(
        "sku", "h", "week_start", F.col("production").alias("units"),
        (F.col("production") / F.col("prod_por_plancha")).alias("sheets"),
        (F.col("production") * F.col("unit_cost")).alias("cost"),
        "urgent",
    )


def plan_cost_totals(cost: DataFrame) -> DataFrame:
    """Y15 per SKU: totals, weeks with production, and the first week with the highest cost above 0."""
    peak = F.when(F.col("cost") > 0, F.struct(F.col("cost"), -F.col("h")))
    return cost.groupBy("sku").agg(
        F.sum("units").alias("units"),
        F.sum("sheets").alias("sheets"),
        F.sum("cost").alias("cost"),
        F.count_if(F.col("units") > 0).alias("weeks"),
        F.max_by("week_start", peak).alias("peak_week"),
        F.max(F.when(F.col("cost") > 0, F.col("cost"))).alias("peak_cost"),
    )


def plan_cost_summary(totals: DataFrame, horizon: int = 52) -> DataFrame:
    """Y15 over all SKUs: investment, sheets and the mean per week of the horizon."""
    return totals.agg(F.sum("cost").alias("investment"), F.sum("sheets").alias("sheets")).withColumn(
        "weekly_mean", F.col("investment") / horizon if horizon > 0 else F.lit(0.0)
    )


def plan_cost_matrix(cost: DataFrame, skus: list[str] | None = None) -> DataFrame:
    """Weeks x SKUs (all, or those listed), whole currency units."""
    return wide(cost, "h", "sku", half_up(F.coalesce(F.sum("cost"), F.lit(0.0))), skus).fillna(0.0)


def plan_cost_by_month(cost: DataFrame) -> DataFrame:
    """Y16."""
    return cost.groupBy("sku", month_label().alias("mes")).agg(
        F.sum("units").alias("units"), F.sum("sheets").alias("sheets"), F.sum("cost").alias("cost"),
        F.bool_or("urgent").alias("urgent"),
    )


def overproduction_cost(summary: DataFrame, costs: DataFrame) -> DataFrame:
    """Y17 per SKU: units never sold and their material cost. ``summary``: Y13."""
    over = F.greatest(F.lit(0), F.col("produccion_total") - F.col("ventas_total"))
    return summary.join(costs.select("sku", "tipo", "prod_por_plancha", "precio"), "sku").select(
        "sku", "tipo", "produccion_total", "ventas_total", "eficiencia", over.alias("sobreproduccion"),
        (over / F.col("prod_por_plancha") * F.col("precio")).alias("costo_material"),
    )


def overproduction_impact(over: DataFrame, rates: DataFrame) -> DataFrame:
    """Y17 over all SKUs: material, extra costs, total impact, multiplier, share, mean efficiency."""
    total = beside(over.agg(
        F.sum("sobreproduccion").alias("sobreproduccion"),
        F.sum("produccion_total").alias("_p"),
        F.coalesce(F.sum("costo_material"), F.lit(0.0)).alias("costo_material"),
        F.mean("eficiencia").alias("eficiencia_media"),
    ), rates.agg(F.sum("pct").alias("_pct")))
    extra = F.col("costo_material") * F.col("_pct") / 100
    return total.select(
        "sobreproduccion", "costo_material", extra.alias("costo_adicional"),
        (F.col("costo_material") + extra).alias("impacto_total"),
        F.when(F.col("costo_material") > 0, 1 + F.col("_pct") / 100).otherwise(1.0).alias("multiplicador"),
        F.coalesce(F.try_divide(F.col("sobreproduccion") * 100, "_p"), F.lit(0.0)).alias("sobreproduccion_pct"),
        "eficiencia_media",
    )


def extra_costs(over: DataFrame, rates: DataFrame) -> DataFrame:
    """One row per extra cost."""
    material = over.agg(F.coalesce(F.sum("costo_material"), F.lit(0.0)).alias("_m"))
    return beside(rates, material).select("key", "pct", (F.col("_m") * F.col("pct") / 100).alias("valor"))


def policy_savings(backtest: DataFrame, costs: DataFrame, weeks: float | str | None = 2.0) -> DataFrame:
    """Y18 per SKU: cost of what was over-produced against holding ``weeks`` of mean sales.
    ``backtest``: F10."""
    real = F.greatest(F.lit(0.0), F.col("produccion_total") - F.col("ventas_total"))
    held = half_up(F.col("avg_semanal") * clamp_safety_weeks(weeks))
    rows = backtest.join(costs.select("sku", "unit_cost"), "sku").select(
        "sku", "n_semanas", real.alias("sobre_real"), held.alias("sobre_sistema"),
        half_up(F.round(real * F.col("unit_cost"), 6)).alias("costo_real"),
        half_up(F.round(held * F.col("unit_cost"), 6)).alias("costo_sistema"),
    )
    return rows.withColumn("ahorro", F.greatest(F.lit(0.0), F.col("costo_real") - F.col("costo_sistema")))


def policy_totals(savings: DataFrame) -> DataFrame:
    """Y18 over all SKUs; reduction in percent with one digit."""
    return savings.agg(
        F.sum("costo_real").alias("costo_real"),
        F.sum(F.least("costo_sistema", "costo_real")).alias("costo_sistema"),
        F.sum("ahorro").alias("ahorro"),
    ).withColumn(
        "reduccion_pct", F.coalesce(F.round(ratio(F.col("ahorro") * 100, F.col("costo_real")), 1), F.lit(0.0))
    )


def efficiency_band(c: Column | str, high: float, middle: float) -> Column:
    """98/90 in the finance view, 95/85 in the product view."""
    value = F.col(c) if isinstance(c, str) else c
    return F.when(value >= high, "alta").when(value >= middle, "media").otherwise("baja")


