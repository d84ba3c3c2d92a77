"""Serving forecasts and planning production."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demand_engine.functions.expressions import half_up, normalize_sku

SAFETY_WEEKS = 2.0
SAFETY_RANGE = (0.5, 12.0)
# Factor and confidence of the scenarios.
SCENARIOS = {"normal": (1.0, 0.9), "optimistic": (1.1, 0.6), "pessimistic": (0.9, 0.95)}


def forecast_lookup(
    forecast: DataFrame, skus: list[str] | DataFrame, periods: int = 52, include_confidence: bool = True
) -> DataFrame:
    """The first ``periods`` points of the asked SKUs, codes compared without blanks and quotes."""
    if not 1 <= periods <= 365:
        raise ValueError("periods must be between 1 and 365")
    asked = skus if isinstance(skus, DataFrame) else forecast.sparkSession.createDataFrame([(s,) for s in skus], "sku string")
    keys = asked.select(normalize_sku("sku").alias("_key")).distinct()
    points = forecast.where(F.col("h") <= periods).withColumn("_key", normalize_sku("sku")).join(keys, "_key", "left_semi")
    out = points.select(
        "sku", F.col("h").alias("period"), F.round("prediction", 2).alias("forecast"),
        F.round("lower", 2).alias("lower"), F.round("upper", 2).alias("upper"),
    )
    if include_confidence:
        return out.withColumn("confidence_level", F.lit(0.95))
    return out.drop("lower", "upper")


def production_scenarios(points: DataFrame) -> DataFrame:
    """Y2: recommended quantity per scenario from the last point asked for. Input: Y1."""
    last = points.groupBy("sku").agg(F.max_by("forecast", "period").alias("_q"))
    levels = F.array(
        *[F.struct(F.lit(k).alias("level"), F.lit(f).alias("f"), F.lit(c).alias("c")) for k, (f, c) in SCENARIOS.items()]
    )
    return last.select("sku", "_q", F.explode(levels).alias("_l")).select(
        "sku", "_l.level", F.round(F.col("_q") * F.col("_l.f"), 2).alias("quantity"), F.col("_l.c").alias("confidence")
    )


def position(weekly: DataFrame, times: float = 5.0, least: float = 100.0) -> DataFrame:
    """What a plan needs of the history, per SKU: median and cap of its weekly sales (Y3), last closing stock and week.

    The cap is 5 x the upper median, at least 100. A SKU's weeks (a few hundred) are sorted as one array.
    """
    sales = F.sort_array(F.collect_list("sales"))
    median = sales[F.floor(F.size(sales) / 2).cast("int")]
    return weekly.groupBy("sku").agg(
        median.alias("median"),
        F.max_by("closing_stock", "week_start").alias("stock"),
        F.max("week_start").alias("last_week"),
    ).withColumn("cap", F.greatest(F.col("median") * times, F.lit(least)))


def sales_cap(weekly: DataFrame, times: float = 5.0, least: float = 100.0) -> DataFrame:
    """Cap per SKU: 5 x the upper median of its weekly sales, at least 100."""
    return position(weekly, times, least).select("sku", "median", "cap")


def capped_forecast(forecast: DataFrame, weekly: DataFrame) -> DataFrame:
    """Forecast points limited to the SKU's cap; SKUs without history are left out."""
    return (
        forecast.join(sales_cap(weekly), "sku")
        .withColumn("demand", F.least("prediction", "cap"))
        .drop("median")
    )


def clamp_safety_weeks(weeks: float | str | None) -> float:
    """0, missing or unreadable counts as 2; otherwise kept within [0.5, 12]."""
    try:
        value = float(weeks or 0)
    except ValueError:
        value = 0.0
    low, high = SAFETY_RANGE
    return max(low, min(high, value if value and value == value else SAFETY_WEEKS))


def safety_stock(capped: DataFrame, weeks: float | str | None = SAFETY_WEEKS) -> DataFrame:
    """Mean capped forecast and the stock that covers ``weeks`` of it, per SKU."""
    factor = clamp_safety_weeks(weeks)
    return capped.groupBy("sku").agg(F.mean("demand").alias("avg_demand")).withColumn(
        "safety_stock", F.col("avg_demand") * factor
    )


def opening_stock(weekly: DataFrame) -> DataFrame:
    """Last closing stock and its week per SKU."""
    return position(weekly).select("sku", "stock", "last_week")


def _plan_rows(forecast: DataFrame, weekly: DataFrame, weeks: float | str | None) -> DataFrame:
    """Unrounded plan. With demand d >= 0 the weekly rule 'refill to the safety stock when the rest
    would fall below it' has the closed form: stock after week h = max(S0 - sum of d, safety stock).
    """
    capped = forecast.join(position(weekly), "sku").withColumn("demand", F.least("prediction", "cap"))
    series = W.partitionBy("sku").orderBy("h")
    mean = F.mean("demand").over(W.partitionBy("sku"))
    used = F.sum("demand").over(series.rowsBetween(W.unboundedPreceding, 0))
    steps = (
        capped.select("sku", "h", "demand", "stock", "last_week")
        .withColumns({"avg_demand": mean, "_used": used})
        .withColumn("safety_stock", F.col("avg_demand") * clamp_safety_weeks(weeks))
        .withColumn("stock_end", F.greatest(F.col("stock") - F.col("_used"), F.col("safety_stock")))
    )
    begin = F.coalesce(F.lag("stock_end").over(series), F.col("stock"))
    return (
        steps.withColumn("stock_start", begin)
        .withColumn("production", F.col("stock_end") - F.col("stock_start") + F.col("demand"))
        .withColumn("urgent", F.col("stock_start") - F.col("demand") < 0)
        .withColumn("week_start", F.date_add("last_week", F.col("h") * 7))
    )


def production_plan(forecast: DataFrame, weekly: DataFrame, weeks: float | str | None = SAFETY_WEEKS) -> DataFrame:
    """Weekly plan per SKU from the last closing stock, whole units."""
    plan = _plan_rows(forecast, weekly, weeks)
    return plan.select(
        "sku", "h", "week_start",
        *[half_up(F.round(c, 6)).alias(c) for c in ("demand", "production", "stock_start", "stock_end")],
        "urgent",
    )


def plan_header(forecast: DataFrame, weekly: DataFrame, weeks: float | str | None = SAFETY_WEEKS) -> DataFrame:
    """Current stock, safety stock, mean demand and weeks with production per SKU."""
    whole = lambda c: half_up(F.round(c, 6))
    return _plan_rows(forecast, weekly, weeks).groupBy("sku").agg(
        F.first(whole(F.col("stock"))).alias("stock_actual"),
        F.first(whole(F.col("safety_stock"))).alias("stock_seguridad"),
        F.first(whole(F.col("avg_demand"))).alias("avg_demand"),
        F.count_if(whole(F.col("production")) > 0).alias("semanas_produccion"),
    )


def _within(plan: DataFrame, horizon: int) -> DataFrame:
    return plan.where(F.col("h") <= horizon)


def plan_kpis(plan: DataFrame, horizon: int = 52) -> DataFrame:
    """Y7 per SKU: units, weeks with production, any urgent week, 0-based first production (-1: none)."""
    makes = F.col("production") > 0
    return _within(plan, horizon).groupBy("sku").agg(
        F.coalesce(F.sum(F.when(makes, F.col("production"))), F.lit(0.0)).alias("units"),
        F.count_if(makes).alias("weeks"),
        F.bool_or("urgent").alias("urgent"),
        F.coalesce(F.min(F.when(makes, F.col("h"))) - 1, F.lit(-1)).alias("first"),
    )


def plan_totals(kpis: DataFrame) -> DataFrame:
    """Y7 over all SKUs."""
    return kpis.agg(
        F.sum("units").alias("units"),
        F.count_if("urgent").alias("urgent_skus"),
        F.count_if(F.col("weeks") > 0).alias("planned_skus"),
    )


def month_label(c: Column | str = "week_start") -> Column:
    return F.date_format(c, "yyyy-MM")


def plan_by_month(plan: DataFrame, horizon: int = 52) -> DataFrame:
    """Production and any urgent week per (SKU, month)."""
    return _within(plan, horizon).groupBy("sku", month_label().alias("mes")).agg(
        F.sum("production").alias("production"), F.bool_or("urgent").alias("urgent")
    )


def largest_month(by_month: DataFrame) -> DataFrame:
    """The largest cell, at least 1 (scale of the heat map)."""
    return by_month.agg(F.greatest(F.max("production"), F.lit(1.0)).alias("max_production"))


def production_weeks(plan: DataFrame) -> DataFrame:
    """Targets of the weeks in which anything is produced, one row per (week, SKU to make).

    Weeks are counted by step; the date shown is the first SKU's, as all calendars run in parallel.
    """
    makes = plan.where(F.col("production") > 0)
    return makes.select("h", F.concat(F.lit("W+"), "h").alias("semana"), "week_start", "sku", F.col("production").alias("meta"))


def production_week_list(plan: DataFrame) -> DataFrame:
    """The weeks themselves: date of the first SKU, number of SKUs to make, units."""
    return plan.groupBy("h").agg(
        F.min_by("week_start", "sku").alias("fecha"),
        F.count_if(F.col("production") > 0).alias("skus"),
        F.sum("production").alias("units"),
    ).where(F.col("skus") > 0)
