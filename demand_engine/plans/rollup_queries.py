"""Checked queries: dashboard roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from demand_engine.functions.expressions import rounded
from demand_engine.operators import cleaning, pareto, profiles, rollups, weekly
from demand_engine.plans.ledger_views import ORDER, clean_ledger
from demand_engine.plans.model_queries import level_forecast
from demand_engine.plans.registry import part, query, sql
from demand_engine.plans.series_queries import brand_dense, brand_weeks
from demand_engine.session import keep_table


def up(x: str, digits: int = 0) -> str:
    scale = 10.0**digits
    return f"floor(({x}) * {scale} + 0.5) / {scale}"


part(
    "by_channel",
    ("sold",),
    f"SELECT sku, canal, {up('SUM(salida)')} AS ventas, COUNT(*) AS transacciones FROM sold GROUP BY sku, canal",
)


@query("d10_channel_by_product", sql("SELECT * FROM by_channel", "by_channel", sku="item"))
def d10_channel_by_product(spark, d):
    return rollups.channel_by_product(clean_ledger(spark, d, sku="item", parties=True))


@query(
    "d11_channel_mix",
    sql(
        f"""SELECT sku, online AS "Online", presencial AS "Presencial", online + presencial AS total,
  {up('100 * online / (online + presencial)')} AS "Online_pct", {up('100 * presencial / (online + presencial)')} AS "Presencial_pct"
FROM (SELECT upper(sku) AS sku, COALESCE(SUM(ventas) FILTER (canal = 'Online'), 0.0) AS online,
        COALESCE(SUM(ventas) FILTER (canal = 'Presencial'), 0.0) AS presencial
      FROM by_channel WHERE sku IN (SELECT sku FROM pareto WHERE in_80) GROUP BY 1)""",
        "by_channel",
        "pareto",
    ),
)
def d11_channel_mix(spark, d):
    clean = clean_ledger(spark, d, parties=True)
    chosen = pareto.pareto_curve(cleaning.sales(clean)).where("in_80")
    return rollups.channel_mix(keep_table(rollups.channel_by_product(clean)), chosen)


@query(
    "d11_channel_shares",
    sql(
        f"""SELECT sku, canal, ventas, total, {up('100 * ventas / total')} AS pct
FROM (SELECT *, SUM(ventas) OVER (PARTITION BY sku) AS total FROM (
        SELECT upper(sku) AS sku, canal, SUM(ventas) AS ventas FROM by_channel WHERE sku IN (SELECT sku FROM pareto WHERE in_80) GROUP BY ALL))""",
        "by_channel",
        "pareto",
    ),
)
def d11_channel_shares(spark, d):
    clean = clean_ledger(spark, d, parties=True)
    chosen = pareto.pareto_curve(cleaning.sales(clean)).where("in_80")
    return rollups.channel_shares(rollups.channel_by_product(clean), chosen)


part(
    "clients",
    ("sold",),
    f"""
SELECT puesto, cliente, ventas, transacciones,
  {up('100 * SUM(ventas) OVER (ORDER BY puesto) / SUM(ventas) OVER ()', 1)} AS acumulado_pct
FROM (SELECT CAST(row_number() OVER (ORDER BY SUM(salida) DESC, cliente) AS INTEGER) AS puesto, cliente,
        {up('SUM(salida)')} AS ventas, COUNT(*) AS transacciones
      FROM sold GROUP BY cliente) WHERE puesto <= 15""",
)


@query("d12_top_clients", sql("SELECT * FROM clients", "clients"))
def d12_top_clients(spark, d):
    return rollups.top_clients(clean_ledger(spark, d, parties=True))


@query(
    "d12_client_concentration",
    sql(
        """SELECT MAX(acumulado_pct) FILTER (puesto = 3) AS top3_pct, MAX(acumulado_pct) FILTER (puesto = 5) AS top5_pct,
  MAX(acumulado_pct) FILTER (puesto = 5) >= 80 AS alta_concentracion FROM clients""",
        "clients",
    ),
)
def d12_client_concentration(spark, d):
    return rollups.client_concentration(rollups.top_clients(clean_ledger(spark, d, parties=True)))


@query(
    "d13_product_summary",
    sql(
        f"""SELECT sku, {up('SUM(sales)')} AS total_ventas, {up('SUM(production)')} AS total_produccion,
  CASE WHEN SUM(production) > 0 THEN {up('SUM(sales) * 100 / SUM(production)', 1)} ELSE 0.0 END AS eficiencia,
  {up('SUM(production) - SUM(sales)')} AS gap_unidades,
  COALESCE({up('SUM(sales) / AVG(closing_stock) FILTER (closing_stock > 0)', 1)}, 0.0) AS rotacion
FROM weekly GROUP BY sku""",
        "weekly",
    ),
)
def d13_product_summary(spark, d):
    return rollups.product_summary(brand_weeks(spark, d))


part(
    "yearly",
    ("weekly",),
    f"""SELECT sku, CAST(year(week_start) AS INTEGER) AS anio, {up('SUM(sales)')} AS ventas, {up('SUM(production)')} AS produccion,
  {up('SUM(production) - SUM(sales)')} AS gap FROM weekly GROUP BY 1, 2""",
)


@query("d14_yearly_by_product", sql("SELECT * FROM yearly", "yearly"))
def d14_yearly_by_product(spark, d):
    return rollups.yearly_by_product(brand_weeks(spark, d))


@query("d15_yearly_wide", sql("SELECT * FROM (PIVOT (SELECT anio, sku, ventas FROM yearly) ON sku USING MAX(ventas) GROUP BY anio)", "yearly"))
def d15_yearly_wide(spark, d):
    return rollups.yearly_wide(keep_table(rollups.yearly_by_product(brand_weeks(spark, d)), "yearly"))


@query(
    "d16_overproduction_kpis",
    sql(
        """SELECT sku, SUM(CASE WHEN gap > 0 THEN gap ELSE 0.0 END) AS sobreproduccion,
  round(AVG(CASE WHEN ventas > 0 THEN gap * 100 / ventas ELSE 0.0 END), 8) + 0.0 AS gap_pct_medio FROM yearly GROUP BY sku""",
        "yearly",
    ),
)
def d16_overproduction_kpis(spark, d):
    out = rollups.overproduction_kpis(rollups.yearly_by_product(brand_weeks(spark, d)))
    return out.withColumn("gap_pct_medio", F.round("gap_pct_medio", 8) + 0.0)


part(
    "by_month",
    ("weekly",),
    f"""
SELECT sku, mes, COALESCE(ventas, 0.0) AS ventas
FROM (SELECT DISTINCT sku FROM weekly) CROSS JOIN (SELECT CAST(m AS INTEGER) AS mes FROM generate_series(1, 12) t(m))
LEFT JOIN (SELECT sku, CAST(month(week_start) AS INTEGER) AS mes, {up('AVG(sales)')} AS ventas FROM weekly GROUP BY 1, 2) USING (sku, mes)""",
)
part(
    "season_index",
    ("by_month",),
    f"SELECT sku, mes, {up('100 * ventas / (SUM(ventas) OVER (PARTITION BY sku) / 12)')} AS indice FROM by_month",
)


@query("d17_monthly_mean_demand", sql("SELECT * FROM by_month", "by_month"))
def d17_monthly_mean_demand(spark, d):
    return rollups.monthly_mean_demand(brand_weeks(spark, d))


@query("d18_seasonality_index", sql("SELECT * FROM season_index", "season_index"))
def d18_seasonality_index(spark, d):
    return rollups.seasonality_index(rollups.monthly_mean_demand(brand_weeks(spark, d)))


@query("d18_seasonality_wide", sql("SELECT * FROM (PIVOT (SELECT mes, sku, indice FROM season_index) ON sku USING MAX(indice) GROUP BY mes)", "season_index"))
def d18_seasonality_wide(spark, d):
    return rollups.seasonality_wide(keep_table(rollups.seasonality_index(rollups.monthly_mean_demand(brand_weeks(spark, d))), "index"))


@query(
    "d19_monthly_lagged",
    sql(
        f"""SELECT sku, mes, produccion, lag(v) OVER (PARTITION BY sku ORDER BY mes) AS ventas_anterior
FROM (SELECT sku, strftime(week_start, '%Y-%m') AS mes, {up('SUM(production)')} AS produccion, {up('SUM(sales)')} AS v
      FROM weekly GROUP BY 1, 2)""",
        "weekly",
    ),
)
def d19_monthly_lagged(spark, d):
    return rollups.monthly_lagged(brand_weeks(spark, d))


@query(
    "d20_global_kpis",
    sql(
        """SELECT SUM(sales) AS ventas, SUM(production) AS produccion, MIN(week_start) AS desde, MAX(week_start) AS hasta,
  (SELECT COUNT(*) FROM pareto WHERE in_80) AS skus,
  (SELECT string_agg(sku, ',' ORDER BY total DESC, sku) FROM (SELECT * FROM pareto WHERE in_80 ORDER BY total DESC, sku LIMIT 7)) AS principales
FROM weekly""",
        "weekly",
        "pareto",
    ),
)
def d20_global_kpis(spark, d):
    clean = clean_ledger(spark, d, names=True)
    sold = cleaning.sales(clean)
    listing = pareto.pareto_listing(profiles.sales_by_product(sold, ORDER), pareto.pareto_curve(sold).where("in_80"))
    return rollups.global_kpis(weekly.weekly_totals(clean), listing)


@query(
    "d21_product_kpis",
    sql(
        """SELECT sku, round(f, 6) AS demanda_media, round(COALESCE(p, 0.0), 6) AS produccion_media,
  round(CASE WHEN p > 0 THEN f * 100 / p ELSE 0.0 END, 6) AS ratio_pct
FROM (SELECT sku, AVG(prediction) AS f FROM forecast GROUP BY sku) LEFT JOIN (
  SELECT sku, AVG(production) AS p FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY week_start DESC) AS rn FROM weekly)
  WHERE rn <= 104 GROUP BY sku) USING (sku)""",
        "forecast",
        "weekly",
    ),
)
def d21_product_kpis(spark, d):
    out = rollups.product_kpis(level_forecast(brand_dense(spark, d)), brand_weeks(spark, d))
    return rounded(out, 6, "demanda_media", "produccion_media", "ratio_pct")
