"""Checked queries: typing, cleaning, outliers, profiles and Pareto (A3, B, C, D1-D9, E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from demand_engine.functions.expressions import rounded
from demand_engine.operators import cleaning, outliers, pareto, profiles, weekly
from demand_engine.plans.ledger_views import ORDER, clean_ledger, movements, table
from demand_engine.plans.registry import query, sql

ROW = ["sku", *ORDER]
ROW_SQL = "sku, fecha, orden, linea, parte, proveedor, importe"


# --- A3, B -------------------------------------------------------------------------------------


@query(
    "a3_coerce_types",
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  CASE WHEN l_linenumber = 7 THEN 0.0 ELSE l_quantity END AS salida,
  CASE WHEN l_returnflag = 'A' THEN 0.0 ELSE l_quantity END AS entrada,
  CASE WHEN l_suppkey % 10 = 9 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS fecha
FROM lineitem""",
)
def a3_coerce_types(spark, d):
    text = table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
        F.when(F.col("l_linenumber") == 7, "n/a").otherwise(F.col("l_quantity").cast("string")).alias("salida"),
        F.when(F.col("l_returnflag") != "A", F.col("l_quantity").cast("string")).alias("entrada"),
        F.when(F.col("l_suppkey") % 10 == 9, "31/31/2000")
        .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
        .alias("fecha"),
    )
    return cleaning.coerce_types(text)


@query("b1_fill_dimension_defaults", sql(f"SELECT {ROW_SQL}, bodega, documento, canal, cliente FROM filled", "filled"))
def b1_fill_dimension_defaults(spark, d):
    filled = cleaning.fill_dimension_defaults(movements(spark, d, parties=True))
    return filled.select(*ROW, "bodega", "documento", "canal", "cliente")


@query("b2_exclude_transfers", sql(f"SELECT {ROW_SQL}, documento, entrada, salida FROM moved", "moved"))
def b2_exclude_transfers(spark, d):
    return cleaning.exclude_transfers(movements(spark, d)).select(*ROW, "documento", "entrada", "salida")


@query("b3_exclude_balanced_guides", sql(f"SELECT {ROW_SQL}, documento, numero, entrada, salida FROM clean", "clean"))
def b3_exclude_balanced_guides(spark, d):
    kept = cleaning.exclude_balanced_guides(cleaning.exclude_transfers(movements(spark, d)))
    return kept.select(*ROW, "documento", "numero", "entrada", "salida")


@query("b4_sales_split", sql(f"SELECT {ROW_SQL}, salida FROM sold", "sold"))
def b4_sales_split(spark, d):
    return cleaning.sales(clean_ledger(spark, d)).select(*ROW, "salida")


@query("b4_production_split", sql(f"SELECT {ROW_SQL}, entrada FROM made", "made"))
def b4_production_split(spark, d):
    return cleaning.production(clean_ledger(spark, d)).select(*ROW, "entrada")


@query(
    "b5_normalize_sku",
    sql(
        """SELECT upper(replace(replace('''' || lower(p_brand) || ' ' || p_type, '''', ''), ' ', '')) AS sku,
  p_partkey, p_size FROM part"""
    ),
)
def b5_normalize_sku(spark, d):
    raw = table(spark, d, "part").select(
        F.concat(F.lit("'"), F.lower("p_brand"), F.lit(" "), F.col("p_type")).alias("sku"), "p_partkey", "p_size"
    )
    return cleaning.with_normalized_sku(raw)


SEVEN = ["brand #1", "Brand#2", "BRAND#3", "'Brand#4", "Brand#5", "Brand#6", "Brand#7"]


@query(
    "b6_target_skus",
    sql(
        f"""SELECT {ROW_SQL}, salida FROM clean
WHERE sku IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5', 'Brand#6', 'Brand#7')""",
        "clean",
    ),
)
def b6_target_skus(spark, d):
    return cleaning.only_skus(clean_ledger(spark, d), SEVEN).select(*ROW, "salida")


@query(
    "b7_since",
    sql(
        """SELECT CAST(date_trunc('week', fecha) AS DATE) AS week_start, SUM(salida) AS sales, SUM(entrada) AS production
FROM clean WHERE date_trunc('week', fecha) >= DATE '1998-01-01' GROUP BY 1""",
        "clean",
    ),
)
def b7_since(spark, d):
    return cleaning.since(weekly.weekly_totals(clean_ledger(spark, d)), "1998-01-01")


@query(
    "b8_last_n_weeks",
    sql(
        """SELECT CAST(date_trunc('week', fecha) AS DATE) AS week_start, SUM(salida) AS sales, SUM(entrada) AS production
FROM clean GROUP BY ALL ORDER BY 1 DESC LIMIT 104""",
        "clean",
    ),
)
def b8_last_n_weeks(spark, d):
    return cleaning.last_n_weeks(weekly.weekly_totals(clean_ledger(spark, d)), 104)


@query(
    "b9_critical_only",
    sql(f"SELECT {ROW_SQL}, salida FROM sold WHERE sku IN (SELECT sku FROM pareto WHERE in_80)", "sold", "pareto", sku="item"),
)
def b9_critical_only(spark, d):
    sold = cleaning.sales(clean_ledger(spark, d, sku="item"))
    return cleaning.critical_only(sold, pareto.pareto_curve(sold).where("in_80")).select(*ROW, "salida")


@query(
    "b10_drop_undated",
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity AS salida,
  CAST(l_shipdate AS DATE) AS fecha
FROM lineitem WHERE l_suppkey % 10 <> 9""",
)
def b10_drop_undated(spark, d):
    return cleaning.drop_undated(cleaning.coerce_types(_dated_text(spark, d), numbers=()))


def _dated_text(spark, d):
    """Lines with their day as text, unreadable for one supplier in ten."""
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").alias("salida"),
        F.when(F.col("l_suppkey") % 10 == 9, "sin fecha")
        .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
        .alias("fecha"),
    )


# --- C -----------------------------------------------------------------------------------------

CAPPED = f"""
SELECT {ROW_SQL},
  CASE WHEN salida > s.cap THEN s.cap ELSE salida END AS salida,
  CASE WHEN entrada > e.cap THEN e.cap ELSE entrada END AS entrada,
  COALESCE(salida > s.cap, FALSE) AS salida_capped, COALESCE(entrada > e.cap, FALSE) AS entrada_capped
FROM clean
LEFT JOIN (SELECT sku, quantile_cont(salida, 0.99) AS cap FROM clean WHERE salida > 0 GROUP BY sku HAVING COUNT(*) >= 4) s USING (sku)
LEFT JOIN (SELECT sku, quantile_cont(entrada, 0.99) AS cap FROM clean WHERE entrada > 0 GROUP BY sku HAVING COUNT(*) >= 4) e USING (sku)"""


@query(
    "c1_cap_p99",
    sql(f"SELECT * REPLACE (round(salida, 4) AS salida, round(entrada, 4) AS entrada) FROM ({CAPPED})", "clean", sku="item"),
)
def c1_cap_p99(spark, d):
    capped = outliers.cap_p99(clean_ledger(spark, d, sku="item"))
    return rounded(capped, 4, "salida", "entrada").select(*ROW, "salida", "entrada", "salida_capped", "entrada_capped")


REPLACED = f"""
SELECT {ROW_SQL}, numero, COALESCE(salida > high OR salida < low, FALSE) AS replaced,
  CASE WHEN salida > high OR salida < low THEN mediana ELSE salida END AS salida
FROM sold LEFT JOIN (
  SELECT sku, q2 AS mediana, greatest(0.0, q1 - 1.5 * (q3 - q1)) AS low, q3 + 1.5 * (q3 - q1) AS high FROM (
    SELECT sku, quantile_cont(salida, 0.25) AS q1, quantile_cont(salida, 0.5) AS q2, quantile_cont(salida, 0.75) AS q3
    FROM sold GROUP BY sku HAVING COUNT(*) >= 4)) USING (sku)"""


@query("c2_replace_iqr_outliers", sql(f"SELECT * EXCLUDE (numero) FROM ({REPLACED})", "sold", sku="item"))
def c2_replace_iqr_outliers(spark, d):
    sold = cleaning.sales(clean_ledger(spark, d, sku="item"))
    return outliers.replace_iqr_outliers(sold).select(*ROW, "replaced", "salida")


@query(
    "c3_outlier_report",
    sql(f"SELECT sku, COUNT(*) AS outliers FROM ({REPLACED}) WHERE replaced GROUP BY ROLLUP (sku)", "sold", sku="item"),
)
def c3_outlier_report(spark, d):
    return outliers.outlier_report(outliers.replace_iqr_outliers(cleaning.sales(clean_ledger(spark, d, sku="item"))))


TOP = """
SELECT sku, COUNT(*) AS transacciones, round(SUM(salida), 2) AS salida_total, round(AVG(salida), 2) AS salida_promedio,
  round(stddev_samp(salida), 2) AS salida_std, round(MIN(salida), 2) AS salida_min, round(MAX(salida), 2) AS salida_max
FROM {source} WHERE salida > 0 GROUP BY sku ORDER BY salida_total DESC, sku LIMIT 20"""


@query(
    "c4_cleaning_summary",
    sql(
        f"""
, capped AS MATERIALIZED ({CAPPED}), top AS MATERIALIZED ({TOP.format(source='capped')})
SELECT (SELECT COUNT(*) FROM mv) AS raw_rows, COUNT(*) AS clean_rows, COUNT(*) FILTER (salida > 0) AS sale_rows,
  COUNT(DISTINCT sku) FILTER (salida > 0) AS products,
  COUNT(*) FILTER (salida > 0 AND sku IN (SELECT sku FROM top)) AS top_rows,
  COUNT(*) FILTER (salida_capped) + COUNT(*) FILTER (entrada_capped) AS capped,
  (SELECT string_agg(sku, ',' ORDER BY salida_total DESC, sku) FROM top) AS top_products
FROM capped""",
        "clean",
        sku="item",
    ),
)
def c4_cleaning_summary(spark, d):
    raw = movements(spark, d, sku="item")
    capped = outliers.cap_p99(cleaning.clean_movements(raw))
    return outliers.cleaning_summary(raw, capped, profiles.top_products(capped, 20))


# --- D1-D9 ---------------------------------------------------------------------------------------


def _profile_sql(source: str, quantity: str) -> str:
    return f"""
SELECT sku, descripcion, num_transacciones, {quantity}_total, round({quantity}_promedio, 4) AS {quantity}_promedio,
  round({quantity}_std, 4) AS {quantity}_std, {quantity}_min, {quantity}_max, row_number() OVER w AS rank,
  round(100 * SUM({quantity}_total) OVER (w ROWS UNBOUNDED PRECEDING) / SUM({quantity}_total) OVER (), 6) AS acumulado_pct
FROM (
  SELECT sku, COUNT(*) AS num_transacciones, SUM({quantity}) AS {quantity}_total, AVG({quantity}) AS {quantity}_promedio,
    stddev_samp({quantity}) AS {quantity}_std, MIN({quantity}) AS {quantity}_min, MAX({quantity}) AS {quantity}_max,
    arg_min(descripcion, row(fecha, orden, linea, parte, proveedor, importe)) AS descripcion
  FROM {source} GROUP BY sku)
WINDOW w AS (ORDER BY {quantity}_total DESC, sku)"""


def _profile(df, q):
    return rounded(rounded(df, 4, f"{q}_promedio", f"{q}_std"), 6, "acumulado_pct")


@query("d1_sales_by_product", sql(_profile_sql("sold", "salida"), "sold", sku="item"))
def d1_sales_by_product(spark, d):
    return _profile(profiles.sales_by_product(clean_ledger(spark, d, sku="item", names=True), ORDER), "salida")


@query("d2_production_by_product", sql(_profile_sql("made", "entrada"), "made", sku="item"))
def d2_production_by_product(spark, d):
    return _profile(profiles.production_by_product(clean_ledger(spark, d, sku="item", names=True), ORDER), "entrada")


STOCK = """
SELECT sku, MIN(saldo) AS stock_min, AVG(saldo) AS stock_promedio, MAX(saldo) AS stock_max,
  stddev_samp(saldo) AS stock_std, COUNT(saldo) AS num_registros FROM clean GROUP BY sku"""


@query(
    "d3_stock_by_product",
    sql(
        f"""SELECT s.* REPLACE (round(stock_promedio, 4) AS stock_promedio, round(stock_std, 4) AS stock_std),
  bodega AS bodega_principal
FROM ({STOCK}) s JOIN (
  SELECT sku, bodega, row_number() OVER (PARTITION BY sku ORDER BY COUNT(*) DESC, bodega) AS rn
  FROM clean GROUP BY sku, bodega) b ON s.sku = b.sku AND rn = 1""",
        "clean",
    ),
)
def d3_stock_by_product(spark, d):
    return rounded(profiles.stock_by_product(clean_ledger(spark, d, balance=True)), 4, "stock_promedio", "stock_std")


@query(
    "d4_inventory_rotation",
    sql(
        f"""SELECT sku, salida_total, descripcion, round(stock_promedio, 4) AS stock_promedio,
  round(salida_total / CASE WHEN stock_promedio = 0 THEN 1.0 ELSE stock_promedio END, 4) AS rotacion
FROM (SELECT sku, SUM(salida) AS salida_total,
        arg_min(descripcion, row(fecha, orden, linea, parte, proveedor, importe)) AS descripcion FROM sold GROUP BY sku)
LEFT JOIN ({STOCK}) USING (sku)""",
        "sold",
    ),
)
def d4_inventory_rotation(spark, d):
    clean = clean_ledger(spark, d, balance=True, names=True)
    out = profiles.inventory_rotation(profiles.sales_by_product(clean, ORDER), profiles.stock_by_product(clean))
    return rounded(out, 4, "stock_promedio", "rotacion")


def _by_sql(key: str) -> str:
    return f"""SELECT {key}, COUNT(*) AS num_transacciones, SUM(salida) AS salida_total,
  COUNT(DISTINCT sku) AS productos_unicos FROM sold GROUP BY {key}"""


@query("d5_sales_by_warehouse", sql(_by_sql("bodega"), "sold", sku="item"))
def d5_sales_by_warehouse(spark, d):
    return profiles.sales_by_warehouse(clean_ledger(spark, d, sku="item"))


@query("d6_sales_by_channel", sql(_by_sql("canal"), "sold", sku="item"))
def d6_sales_by_channel(spark, d):
    return profiles.sales_by_channel(clean_ledger(spark, d, sku="item", parties=True))


@query(
    "d7_monthly_trend",
    sql(
        """SELECT CAST(year(fecha) AS INTEGER) AS anio, CAST(month(fecha) AS INTEGER) AS mes,
  COUNT(*) AS num_transacciones, SUM(salida) AS salida_total, strftime(MIN(fecha), '%Y-%m') AS anio_mes
FROM sold GROUP BY 1, 2""",
        "sold",
    ),
)
def d7_monthly_trend(spark, d):
    return profiles.monthly_trend(clean_ledger(spark, d))


@query("d8_top_products", sql(TOP.format(source="clean"), "clean", sku="item"))
def d8_top_products(spark, d):
    return profiles.top_products(clean_ledger(spark, d, sku="item"), 20)


@query(
    "d8_top_product_rows",
    sql(f"SELECT {ROW_SQL}, salida FROM sold WHERE sku IN (SELECT sku FROM ({TOP.format(source='clean')}))", "sold", sku="item"),
)
def d8_top_product_rows(spark, d):
    sold = cleaning.sales(clean_ledger(spark, d, sku="item"))
    return profiles.restrict_to(sold, profiles.top_products(sold, 20)).select(*ROW, "salida")


@query(
    "d9_run_summary",
    sql(
        """SELECT COUNT(*) AS registros_totales, MIN(fecha) AS fecha_min, MAX(fecha) AS fecha_max,
  COUNT(DISTINCT sku) AS productos_totales, COUNT(DISTINCT date_trunc('week', fecha)) AS semanas_analizadas,
  (SELECT COUNT(*) FROM curve) AS productos_con_ventas,
  (SELECT COUNT(*) FROM curve WHERE cum_pct <= 80) AS productos_pareto FROM clean""",
        "clean",
        "curve",
        sku="item",
    ),
)
def d9_run_summary(spark, d):
    return profiles.run_summary(clean_ledger(spark, d, sku="item"))


# --- E -------------------------------------------------------------------------------------------


def _curve(spark, d, sku):
    return pareto.pareto_curve(cleaning.sales(clean_ledger(spark, d, sku=sku)))


@query("e1_pareto_curve", sql("SELECT * REPLACE (round(cum_pct, 6) AS cum_pct) FROM pareto", "pareto", sku="item"))
def e1_pareto_curve(spark, d):
    return rounded(_curve(spark, d, "item"), 6, "cum_pct")


CUT = """SELECT COUNT(*) AS products, COUNT(*) FILTER (in_80) AS products_80, COUNT(*) FILTER (in_90) AS products_90
FROM pareto"""


@query("e2_pareto_cut", sql(CUT, "pareto", sku="item"))
def e2_pareto_cut(spark, d):
    return pareto.pareto_cut(_curve(spark, d, "item"))


@query("e2_pareto_cut_brand", sql(CUT, "pareto"))
def e2_pareto_cut_brand(spark, d):
    return pareto.pareto_cut(_curve(spark, d, "brand"))


@query(
    "e3_pareto_summary",
    sql(
        """SELECT *, round(100.0 * products_80 / products, 1) AS coverage_80, round(100.0 * products_90 / products, 1) AS coverage_90
FROM (SELECT COUNT(*) AS products, COUNT(*) FILTER (in_80) AS products_80, COUNT(*) FILTER (in_90) AS products_90,
  SUM(total) FILTER (in_80) AS critical_total, round(100.0 * SUM(total) FILTER (in_80) / SUM(total), 1) AS critical_pct
  FROM pareto)""",
        "pareto",
        sku="item",
    ),
)
def e3_pareto_summary(spark, d):
    return pareto.pareto_summary(_curve(spark, d, "item"))


@query(
    "e4_pareto_listing",
    sql(
        """SELECT sku, descripcion, total AS ventas, round(cum_pct, 6) AS pct FROM pareto JOIN (
  SELECT sku, arg_min(descripcion, row(fecha, orden, linea, parte, proveedor, importe)) AS descripcion
  FROM sold GROUP BY sku) USING (sku) WHERE in_80""",
        "pareto",
        sku="item",
    ),
)
def e4_pareto_listing(spark, d):
    sold = cleaning.sales(clean_ledger(spark, d, sku="item", names=True))
    listed = pareto.pareto_listing(
        profiles.sales_by_product(sold, ORDER), pareto.pareto_curve(sold).where("in_80")
    )
    return rounded(listed, 6, "pct")
