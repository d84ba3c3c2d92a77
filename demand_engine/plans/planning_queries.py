"""Checked queries: forecast serving, production plan, sheet material.

The plan in SQL is the weekly loop itself (a recursive query), not the closed form Spark uses.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demand_engine.functions.expressions import rounded
from demand_engine.operators import forecast, materials, planning, weekly
from demand_engine.plans.ledger_views import ORDER, clean_ledger, table
from demand_engine.plans.model_queries import fitted_two, level_forecast
from demand_engine.plans.registry import PARTS, part, query, sql
from demand_engine.plans.rollup_queries import up
from demand_engine.plans.series_queries import brand_dense, brand_weeks
from demand_engine.session import keep_table

HORIZON = 26


def whole(x: str) -> str:
    return f"floor(round({x}, 6) + 0.5)"


def forecast_of(spark, d) -> DataFrame:
    return level_forecast(keep_table(brand_dense(spark, d), "dense"))  # read for the level and for the season


def plan_of(spark, d) -> DataFrame:
    return planning.production_plan(forecast_of(spark, d), brand_weeks(spark, d))


# --- Y1-Y9 ---------------------------------------------------------------------------------------

part(
    "points",
    ("forecast",),
    """SELECT sku, h AS period, round(prediction, 2) AS forecast, round(lower, 2) AS lower, round(upper, 2) AS upper,
  0.95::DOUBLE AS confidence_level FROM forecast WHERE h <= 13""",
)


@query("y1_forecast_lookup", sql("SELECT * FROM points", "points"))
def y1_forecast_lookup(spark, d):
    asked = table(spark, d, "part").select(F.lower("p_brand").alias("sku"))
    return planning.forecast_lookup(forecast_of(spark, d), asked, 13)


@query(
    "y2_production_scenarios",
    sql(
        """SELECT sku, level, round(forecast * factor, 2) AS quantity, confidence
FROM (SELECT * FROM points WHERE period = 13) CROSS JOIN (VALUES ('normal', 1.0::DOUBLE, 0.9::DOUBLE),
  ('optimistic', 1.1::DOUBLE, 0.6::DOUBLE), ('pessimistic', 0.9::DOUBLE, 0.95::DOUBLE)) t(level, factor, confidence)""",
        "points",
    ),
)
def y2_production_scenarios(spark, d):
    asked = table(spark, d, "part").select(F.col("p_brand").alias("sku"))
    return planning.production_scenarios(planning.forecast_lookup(forecast_of(spark, d), asked, 13))


part(
    "caps",
    ("weekly",),
    """
SELECT sku, sales AS median, greatest(sales * 5, 100.0) AS cap FROM (
  SELECT *, row_number() OVER (PARTITION BY sku ORDER BY sales) - 1 AS r, COUNT(*) OVER (PARTITION BY sku) AS n FROM weekly)
WHERE r = n // 2""",
)
part("capped", ("forecast", "caps"), "SELECT sku, h, least(prediction, cap) AS demand FROM forecast JOIN caps USING (sku)")
part(
    "opening",
    ("weekly", "capped"),
    """
SELECT sku, arg_max(closing_stock, week_start) AS stock, MAX(week_start) AS last_week, s.avg_demand, s.avg_demand * 2 AS safety_stock
FROM weekly JOIN (SELECT sku, AVG(demand) AS avg_demand FROM capped GROUP BY sku) s USING (sku) GROUP BY sku, s.avg_demand""",
)
part(
    "raw_plan",
    ("opening", "capped"),
    """
SELECT sku, 0 AS h, stock AS stock_end, 0.0::DOUBLE AS stock_start, 0.0::DOUBLE AS demand, 0.0::DOUBLE AS production, FALSE AS urgent FROM opening
UNION ALL
SELECT sku, h, stock + production - demand, stock, demand, production, stock - demand < 0 FROM (
  SELECT p.sku, c.h, p.stock_end AS stock, c.demand,
    CASE WHEN p.stock_end - c.demand < o.safety_stock THEN greatest(0.0, c.demand + o.safety_stock - p.stock_end) ELSE 0.0 END AS production
  FROM raw_plan p JOIN capped c ON c.sku = p.sku AND c.h = p.h + 1 JOIN opening o ON o.sku = p.sku)""",
)
part(
    "plan",
    ("raw_plan", "opening"),
    f"""
SELECT sku, CAST(h AS INTEGER) AS h, CAST(last_week + 7 * CAST(h AS INTEGER) AS DATE) AS week_start,
  {whole('demand')} AS demand, {whole('production')} AS production, {whole('stock_start')} AS stock_start,
  {whole('stock_end')} AS stock_end, urgent
FROM raw_plan JOIN opening USING (sku) WHERE h > 0""",
)


# The same plan on the fitted, recursive forecast.
for _name, _needs in (("capped", ("forecast_two", "caps")), ("opening", ("weekly", "capped_two")), ("raw_plan", ("opening_two", "capped_two")),
                      ("plan", ("raw_plan_two", "opening_two"))):
    _body = PARTS[_name]
    for _old in ("forecast", "capped", "opening", "raw_plan"):
        _body = re.sub(rf"\b(FROM|JOIN) {_old}\b", rf"\1 {_old}_two", _body)
    part(f"{_name}_two", _needs, _body)


@query("y5_plan_on_recursive_forecast", sql("SELECT * FROM plan_two", "plan_two"))
def y5_plan_on_recursive_forecast(spark, d):
    return planning.production_plan(forecast.recursive_forecast(*fitted_two(spark, d)), brand_weeks(spark, d))


@query("y3_forecast_cap", sql("SELECT sku, h, demand FROM capped", "capped"))
def y3_forecast_cap(spark, d):
    return planning.capped_forecast(forecast_of(spark, d), brand_weeks(spark, d)).select("sku", "h", "demand")


@query(
    "y4_safety_stock",
    sql("SELECT sku, round(avg_demand, 6) AS avg_demand, round(safety_stock, 6) AS safety_stock FROM opening", "opening"),
)
def y4_safety_stock(spark, d):
    capped = planning.capped_forecast(forecast_of(spark, d), brand_weeks(spark, d))
    return rounded(planning.safety_stock(capped, 2), 6, "avg_demand", "safety_stock")


@query("y5_production_plan", sql("SELECT * FROM plan", "plan"))
def y5_production_plan(spark, d):
    return plan_of(spark, d)


@query(
    "y6_plan_header",
    sql(
        f"""SELECT sku, {whole('stock')} AS stock_actual, {whole('safety_stock')} AS stock_seguridad, {whole('avg_demand')} AS avg_demand,
  n AS semanas_produccion FROM opening JOIN (SELECT sku, COUNT(*) FILTER (production > 0) AS n FROM plan GROUP BY sku) USING (sku)""",
        "opening",
        "plan",
    ),
)
def y6_plan_header(spark, d):
    return planning.plan_header(forecast_of(spark, d), brand_weeks(spark, d))


part(
    "kpis",
    ("plan",),
    f"""
SELECT sku, COALESCE(SUM(production) FILTER (production > 0), 0.0) AS units, COUNT(*) FILTER (production > 0) AS weeks,
  bool_or(urgent) AS urgent, CAST(COALESCE(MIN(h) FILTER (production > 0) - 1, -1) AS INTEGER) AS first
FROM plan WHERE h <= {HORIZON} GROUP BY sku""",
)


@query("y7_plan_kpis", sql("SELECT * FROM kpis", "kpis"))
def y7_plan_kpis(spark, d):
    return planning.plan_kpis(plan_of(spark, d), HORIZON)


@query(
    "y7_plan_totals",
    sql(
        """SELECT SUM(units) AS units, COUNT(*) FILTER (urgent) AS urgent_skus, COUNT(*) FILTER (weeks > 0) AS planned_skus
FROM kpis""",
        "kpis",
    ),
)
def y7_plan_totals(spark, d):
    return planning.plan_totals(planning.plan_kpis(plan_of(spark, d), HORIZON))


BY_MONTH = "SELECT sku, strftime(week_start, '%Y-%m') AS mes, SUM(production) AS production, bool_or(urgent) AS urgent FROM plan GROUP BY 1, 2"


@query("y8_plan_by_month", sql(BY_MONTH, "plan"))
def y8_plan_by_month(spark, d):
    return planning.plan_by_month(plan_of(spark, d))


@query("y8_largest_month", sql(f"SELECT greatest(MAX(production), 1.0) AS max_production FROM ({BY_MONTH})", "plan"))
def y8_largest_month(spark, d):
    return planning.largest_month(planning.plan_by_month(plan_of(spark, d)))


@query(
    "y9_production_weeks",
    sql("SELECT h, 'W+' || CAST(h AS VARCHAR) AS semana, week_start, sku, production AS meta FROM plan WHERE production > 0", "plan"),
)
def y9_production_weeks(spark, d):
    return planning.production_weeks(plan_of(spark, d))


@query(
    "y9_production_week_list",
    sql(
        """SELECT h, arg_min(week_start, sku) AS fecha, COUNT(*) FILTER (production > 0) AS skus, SUM(production) AS units
FROM plan GROUP BY h HAVING COUNT(*) FILTER (production > 0) > 0""",
        "plan",
    ),
)
def y9_production_week_list(spark, d):
    return planning.production_week_list(plan_of(spark, d))


# --- A12, Y10-Y19: sheet types, yields and prices per brand come from the part table ---------------

part(
    "config",
    (),
    """
SELECT sku, tipo, prod_por_plancha, precio, precio / prod_por_plancha AS unit_cost,
  CASE WHEN tipo = '0.75' THEN 0.007::DOUBLE ELSE 0.009::DOUBLE END AS sheets_per_unit
FROM (SELECT *, CASE WHEN tipo = '0.75' THEN 129.95::DOUBLE ELSE 201.63::DOUBLE END AS precio FROM (
  SELECT {code} AS sku, CASE WHEN COUNT(*) % 2 = 0 OR MAX(p_size) % 2 = 0 THEN '0.75' ELSE '1.20' END AS tipo,
    CAST(100 + MAX(p_size) AS INTEGER) AS prod_por_plancha FROM part GROUP BY 1))""",
)


def yields_of(spark, d, sku="brand") -> DataFrame:
    code = F.col("p_brand") if sku == "brand" else F.col("p_partkey").cast("string")
    return table(spark, d, "part").groupBy(code.alias("sku")).agg(
        F.when((F.count("*") % 2 == 0) | (F.max("p_size") % 2 == 0), "0.75").otherwise("1.20").alias("tipo"),
        (100 + F.max("p_size")).cast("int").alias("prod_por_plancha"),
    )


def brand_costs(spark, d, sku="brand") -> DataFrame:
    prices, _ = materials.sheet_config(spark)
    return materials.unit_cost(prices, yields_of(spark, d, sku))


def brand_sheets(spark, d, sku="brand") -> DataFrame:
    return brand_costs(spark, d, sku).select(
        "sku", F.when(F.col("tipo") == "0.75", 0.007).otherwise(0.009).alias("sheets_per_unit"), F.col("precio").alias("price")
    )


@query(
    "a12_sheet_config",
    sql("SELECT sku, tipo, prod_por_plancha, precio, round(unit_cost, 8) AS unit_cost FROM config", "config"),
)
def a12_sheet_config(spark, d):
    return rounded(brand_costs(spark, d), 8, "unit_cost")


part(
    "consumption",
    ("weekly", "config"),
    """SELECT sku, week_start, sales, production, sales * sheets_per_unit AS sheets_sales,
  production * sheets_per_unit AS sheets_production FROM weekly JOIN config USING (sku)""",
)


def consumption_of(spark, d):
    return materials.sheet_consumption(brand_weeks(spark, d), brand_sheets(spark, d))


@query(
    "y10_sheet_consumption",
    sql("SELECT * REPLACE (round(sheets_sales, 6) AS sheets_sales, round(sheets_production, 6) AS sheets_production) FROM consumption", "consumption"),
)
def y10_sheet_consumption(spark, d):
    return rounded(consumption_of(spark, d), 6, "sheets_sales", "sheets_production")


@query(
    "y11_sheet_gap",
    sql("SELECT sku, week_start, round(sheets_production - sheets_sales, 6) + 0.0 AS sheets_gap FROM consumption", "consumption"),
)
def y11_sheet_gap(spark, d):
    out = materials.sheet_gap(consumption_of(spark, d))
    return out.select("sku", "week_start", (F.round("sheets_gap", 6) + 0.0).alias("sheets_gap"))


@query(
    "y12_sheet_weekly_total",
    sql(
        """SELECT week_start, round(SUM(sheets_sales), 6) AS sheets_sales, round(SUM(sheets_production), 6) AS sheets_production
FROM consumption GROUP BY week_start""",
        "consumption",
    ),
)
def y12_sheet_weekly_total(spark, d):
    return rounded(materials.sheet_weekly_total(consumption_of(spark, d)), 6, "sheets_sales", "sheets_production")


part(
    "summary",
    ("weekly", "config"),
    """
SELECT sku, CAST(trunc(p) AS BIGINT) AS produccion_total, CAST(trunc(s) AS BIGINT) AS ventas_total,
  round(p * u, 2) AS planchas_produccion, round(s * u, 2) AS planchas_ventas, round(p * u - s * u, 2) AS planchas_gap,
  round(p * u * precio, 2) AS costo_produccion, round(s * u * precio, 2) AS costo_ventas,
  round((p * u - s * u) * precio, 2) AS ahorro_potencial, CASE WHEN p > 0 THEN round(s / p * 100, 1) ELSE 0.0 END AS eficiencia
FROM (SELECT sku, SUM(production) AS p, SUM(sales) AS s, MAX(sheets_per_unit) AS u, MAX(precio) AS precio
      FROM weekly JOIN config USING (sku) GROUP BY sku)""",
)


def weeks_of(spark, d, sku="brand") -> DataFrame:
    return weekly.weekly_by_sku(clean_ledger(spark, d, sku=sku, balance=True), ORDER, sparse=sku == "item")


def summary_of(spark, d, sku="brand"):
    return materials.sheet_cost_summary(weeks_of(spark, d, sku), brand_sheets(spark, d, sku))


@query("y13_sheet_cost_summary", sql("SELECT * FROM summary", "summary"))
def y13_sheet_cost_summary(spark, d):
    return summary_of(spark, d)


@query("y14_sheet_totals", sql("SELECT sku, planchas_produccion, planchas_ventas, planchas_gap FROM summary", "summary"))
def y14_sheet_totals(spark, d):
    return materials.sheet_totals(summary_of(spark, d))


part(
    "cost",
    ("plan", "config"),
    f"""SELECT sku, h, week_start, production AS units, production / prod_por_plancha AS sheets, production * unit_cost AS cost, urgent
FROM plan JOIN config USING (sku) WHERE h <= {HORIZON}""",
)
part(
    "cost_totals",
    ("cost",),
    """
SELECT sku, SUM(units) AS units, SUM(sheets) AS sheets, SUM(cost) AS cost, COUNT(*) FILTER (units > 0) AS weeks,
  arg_max(week_start, row(cost, -h)) FILTER (cost > 0) AS peak_week, MAX(cost) FILTER (cost > 0) AS peak_cost FROM cost GROUP BY sku""",
)


def cost_of(spark, d):
    return materials.plan_cost(plan_of(spark, d), brand_costs(spark, d), HORIZON)


@query(
    "y15_plan_cost",
    sql("SELECT * REPLACE (round(sheets, 6) AS sheets, round(cost, 6) AS cost) FROM cost", "cost"),
)
def y15_plan_cost(spark, d):
    return rounded(cost_of(spark, d), 6, "sheets", "cost")


@query(
    "y15_plan_cost_totals",
    sql("SELECT * REPLACE (round(sheets, 4) AS sheets, round(cost, 4) AS cost, round(peak_cost, 4) AS peak_cost) FROM cost_totals", "cost_totals"),
)
def y15_plan_cost_totals(spark, d):
    return rounded(materials.plan_cost_totals(cost_of(spark, d)), 4, "sheets", "cost", "peak_cost")


@query(
    "y15_plan_cost_summary",
    sql(
        f"""SELECT round(SUM(cost), 4) AS investment, round(SUM(sheets), 4) AS sheets, round(SUM(cost) / {HORIZON}, 4) AS weekly_mean
FROM cost_totals""",
        "cost_totals",
    ),
)
def y15_plan_cost_summary(spark, d):
    out = materials.plan_cost_summary(materials.plan_cost_totals(cost_of(spark, d)), HORIZON)
    return rounded(out, 4, "investment", "sheets", "weekly_mean")


@query(
    "y15_plan_cost_matrix",
    sql("SELECT h, COALESCE(COLUMNS(* EXCLUDE (h)), 0.0) FROM (PIVOT (SELECT h, sku, cost FROM cost) ON sku USING floor(SUM(cost) + 0.5) GROUP BY h)", "cost"),
)
def y15_plan_cost_matrix(spark, d):
    return materials.plan_cost_matrix(keep_table(cost_of(spark, d), "cost"))


@query(
    "y16_plan_cost_by_month",
    sql(
        """SELECT sku, strftime(week_start, '%Y-%m') AS mes, SUM(units) AS units, round(SUM(sheets), 4) AS sheets,
  round(SUM(cost), 4) AS cost, bool_or(urgent) AS urgent FROM cost GROUP BY 1, 2""",
        "cost",
    ),
)
def y16_plan_cost_by_month(spark, d):
    return rounded(materials.plan_cost_by_month(cost_of(spark, d)), 4, "sheets", "cost")


part(
    "overs",
    ("summary", "config"),
    """
SELECT sku, tipo, produccion_total, ventas_total, eficiencia, greatest(0, produccion_total - ventas_total) AS sobreproduccion,
  greatest(0, produccion_total - ventas_total) / prod_por_plancha * precio AS costo_material FROM summary JOIN config USING (sku)""",
)


def over_of(spark, d):
    """By item: some items are made more than sold, brands are not."""
    return materials.overproduction_cost(summary_of(spark, d, "item"), brand_costs(spark, d, "item"))


@query("y17_overproduction_cost", sql("SELECT * REPLACE (round(costo_material, 6) AS costo_material) FROM overs", "overs", sku="item"))
def y17_overproduction_cost(spark, d):
    return rounded(over_of(spark, d), 6, "costo_material")


@query(
    "y17_overproduction_impact",
    sql(
        """SELECT CAST(SUM(sobreproduccion) AS BIGINT) AS sobreproduccion, round(SUM(costo_material), 4) AS costo_material,
  round(SUM(costo_material) * 52 / 100, 4) AS costo_adicional, round(SUM(costo_material) * 1.52, 4) AS impacto_total,
  CASE WHEN SUM(costo_material) > 0 THEN 1.52::DOUBLE ELSE 1.0 END AS multiplicador,
  round(COALESCE(SUM(sobreproduccion) * 100 / SUM(produccion_total), 0.0), 6) AS sobreproduccion_pct,
  round(AVG(eficiencia), 6) AS eficiencia_media FROM overs""",
        "overs", sku="item"))
def y17_overproduction_impact(spark, d):
    out = materials.overproduction_impact(over_of(spark, d), materials.extra_rates(spark))
    out = rounded(out, 4, "costo_material", "costo_adicional", "impacto_total")
    return rounded(out, 6, "multiplicador", "sobreproduccion_pct", "eficiencia_media")


@query(
    "y17_extra_costs",
    sql(
        "SELECT key, pct, round((SELECT COALESCE(SUM(costo_material), 0.0) FROM overs) * pct / 100, 4) AS valor FROM (VALUES "
        + ", ".join(f"('{k}', {float(v)}::DOUBLE)" for k, v in materials.EXTRA_RATES.items())
        + ") t(key, pct)",
        "overs", sku="item"))
def y17_extra_costs(spark, d):
    return rounded(materials.extra_costs(over_of(spark, d), materials.extra_rates(spark)), 4, "valor")


part(
    "savings",
    ("weekly", "config"),
    f"""
SELECT sku, n_semanas, sobre_real, sobre_sistema, costo_real, costo_sistema, greatest(0.0, costo_real - costo_sistema) AS ahorro
FROM (SELECT *, {whole('sobre_real * unit_cost')} AS costo_real, {whole('sobre_sistema * unit_cost')} AS costo_sistema FROM (
  SELECT sku, COUNT(*) AS n_semanas, greatest(0.0, {up('SUM(production)')} - {up('SUM(sales)')}) AS sobre_real,
    {up(up('SUM(sales) / COUNT(*)') + ' * 2')} AS sobre_sistema, MAX(unit_cost) AS unit_cost
  FROM weekly JOIN config USING (sku) GROUP BY sku))""",
)


def savings_of(spark, d):
    return materials.policy_savings(weekly.backtest_series(weeks_of(spark, d, "item")), brand_costs(spark, d, "item"), 2)


@query("y18_policy_savings", sql("SELECT * FROM savings", "savings", sku="item"))
def y18_policy_savings(spark, d):
    return savings_of(spark, d)


@query(
    "y18_policy_totals",
    sql(
        """SELECT SUM(costo_real) AS costo_real, SUM(least(costo_sistema, costo_real)) AS costo_sistema, SUM(ahorro) AS ahorro,
  COALESCE(round(SUM(ahorro) * 100 / nullif(SUM(costo_real), 0), 1), 0.0) AS reduccion_pct FROM savings""",
        "savings", sku="item"))
def y18_policy_totals(spark, d):
    return materials.policy_totals(savings_of(spark, d))


def _band(high: int, middle: int) -> str:
    return f"CASE WHEN eficiencia >= {high} THEN 'alta' WHEN eficiencia >= {middle} THEN 'media' ELSE 'baja' END"


@query(
    "y19_efficiency_band",
    sql(f"SELECT sku, eficiencia, {_band(98, 90)} AS finanzas, {_band(95, 85)} AS productos FROM summary", "summary"),
)
def y19_efficiency_band(spark, d):
    return summary_of(spark, d).select(
        "sku", "eficiencia",
        materials.efficiency_band("eficiencia", 98, 90).alias("finanzas"),
        materials.efficiency_band("eficiencia", 95, 85).alias("productos"),
    )
