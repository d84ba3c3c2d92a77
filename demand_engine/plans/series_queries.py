"""Checked queries: weekly series, features and demand classes (F, G, K)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demand_engine.functions.expressions import rounded
from demand_engine.operators import cleaning, demand_class, features, weekly
from demand_engine.plans.ledger_views import ORDER, clean_ledger
from demand_engine.plans.registry import part, query, sql

KEYS = ["sku", "week_start"]

part(
    "weeks",
    ("clean",),
    """SELECT week_start, SUM(sales) AS sales, SUM(production) AS production, SUM(closing_stock) AS closing_stock FROM (
  SELECT sku, CAST(date_trunc('week', fecha) AS DATE) AS week_start, SUM(salida) AS sales, SUM(entrada) AS production,
    arg_max(saldo, row(fecha, orden, linea, parte, proveedor, importe)) AS closing_stock FROM clean GROUP BY 1, 2)
GROUP BY week_start""",
)


def _mode_sql(column: str, alias: str) -> str:
    return f"""SELECT sku, week_start, {column} AS {alias} FROM (
  SELECT sku, week_start, {column}, row_number() OVER (PARTITION BY sku, week_start ORDER BY COUNT(*) DESC, {column}) AS rn
  FROM sw WHERE {column} IS NOT NULL GROUP BY sku, week_start, {column}) WHERE rn = 1"""


part("sw", ("sold",), "SELECT *, CAST(date_trunc('week', fecha) AS DATE) AS week_start FROM sold")
part(
    "demand",
    ("sw",),
    f"""
SELECT s.*, COALESCE(cliente_modo, 'Unknown') AS cliente_modo, COALESCE(canal_modo, 'Unknown') AS canal_modo,
  COALESCE(punto_modo, 'Unknown') AS punto_modo,
  CAST(isoyear(s.week_start) AS INTEGER) AS iso_year, CAST(weekofyear(s.week_start) AS INTEGER) AS iso_week
FROM (SELECT sku, week_start, SUM(salida) AS salida, COUNT(*) AS transacciones, AVG(salida) AS salida_promedio,
        stddev_samp(salida) AS salida_std, MIN(salida) AS salida_min, MAX(salida) AS salida_max
      FROM sw GROUP BY sku, week_start) s
LEFT JOIN ({_mode_sql('cliente', 'cliente_modo')}) USING (sku, week_start)
LEFT JOIN ({_mode_sql('canal', 'canal_modo')}) USING (sku, week_start)
LEFT JOIN ({_mode_sql('punto', 'punto_modo')}) USING (sku, week_start)""",
)
part(
    "grid",
    ("demand",),
    """
SELECT sku, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS week_start
FROM (SELECT sku, MIN(week_start) AS a, MAX(week_start) AS b FROM demand GROUP BY sku HAVING COUNT(*) >= 2)""",
)
part(
    "gaps",
    ("grid", "demand"),
    """
SELECT g.sku, g.week_start, CAST(isoyear(g.week_start) AS INTEGER) AS iso_year,
  CAST(weekofyear(g.week_start) AS INTEGER) AS iso_week, d.salida, d.transacciones, d.salida_promedio, d.salida_std,
  d.salida_min, d.salida_max, d.cliente_modo, d.canal_modo, d.punto_modo, d.sku IS NULL AS is_imputed
FROM grid g LEFT JOIN demand d ON g.sku = d.sku AND g.week_start = d.week_start""",
)
part(
    "dense",
    ("gaps",),
    """
SELECT sku, week_start, iso_year, iso_week, is_imputed,
  COALESCE(salida, v0 + (v1 - v0) / (datediff('day', w0, w1) / 7) * (datediff('day', w0, week_start) / 7)) AS salida,
  COALESCE(transacciones, 0) AS transacciones, COALESCE(salida_promedio, 0) AS salida_promedio,
  COALESCE(salida_std, 0) AS salida_std, COALESCE(salida_min, 0) AS salida_min, COALESCE(salida_max, 0) AS salida_max,
  COALESCE(cliente_modo, c0, 'Unknown') AS cliente_modo, COALESCE(canal_modo, k0, 'Unknown') AS canal_modo,
  COALESCE(punto_modo, p0, 'Unknown') AS punto_modo
FROM (SELECT *, last_value(salida IGNORE NULLS) OVER b AS v0, first_value(salida IGNORE NULLS) OVER a AS v1,
        last_value(CASE WHEN NOT is_imputed THEN week_start END IGNORE NULLS) OVER b AS w0,
        first_value(CASE WHEN NOT is_imputed THEN week_start END IGNORE NULLS) OVER a AS w1,
        last_value(cliente_modo IGNORE NULLS) OVER b AS c0, last_value(canal_modo IGNORE NULLS) OVER b AS k0,
        last_value(punto_modo IGNORE NULLS) OVER b AS p0
      FROM gaps
      WINDOW b AS (PARTITION BY sku ORDER BY week_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             a AS (PARTITION BY sku ORDER BY week_start ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
)


def _lag(n: int) -> str:
    return f"lag(salida, {n}) OVER s"


_MA = {w: f"AVG(salida) OVER (s ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)" for w in features.AVERAGES}


def _ewma(span: int) -> str:
    a = 2.0 / (span + 1)
    keep = 1.0 - a
    return (
        f"SUM(salida * (CASE WHEN i = 0 THEN 1.0 ELSE {a!r}::DOUBLE END) * pow({keep!r}::DOUBLE, -i)) "
        f"OVER (s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) * pow({keep!r}::DOUBLE, i - 1)"
    )


part(
    "raw_features",
    ("dense",),
    f"""
SELECT *, CASE WHEN salida > 0 AND ma_4 > 0 AND salida < 0.70::DOUBLE * ma_4 THEN 1 ELSE 0 END AS anomalia_binaria,
  COALESCE((salida - ma_4) / nullif(ma_4, 0), 0.0) AS trend_vs_ma4,
  COALESCE((salida - ma_8) / nullif(ma_8, 0), 0.0) AS trend_vs_ma8,
  CAST(row_number() OVER (PARTITION BY sku, island ORDER BY week_start) - 1 AS INTEGER) AS semanas_desde_ultima_venta,
  greatest(0.0, least(5.0, COALESCE(lag_1 / nullif(lag_52, 0), 1.0))) AS yoy_ratio,
  salida_min / CASE WHEN salida_max = 0 THEN 1 ELSE salida_max END AS ratio_min_max,
  salida_std / CASE WHEN salida_promedio = 0 THEN 1 ELSE salida_promedio END AS variabilidad_intra,
  sin(2 * pi() * num_semana_anio / 52) AS semana_sin, cos(2 * pi() * num_semana_anio / 52) AS semana_cos,
  sin(2 * pi() * (mes - 1) / 12) AS mes_sin, cos(2 * pi() * (mes - 1) / 12) AS mes_cos
FROM (
  SELECT *, {", ".join(f"{_lag(n)} AS lag_{n}" for n in features.LAGS)},
    {", ".join(f"{sql_} AS ma_{w}" for w, sql_ in _MA.items())},
    {", ".join(f"COALESCE(stddev_samp(salida) OVER (s ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING), 0.0) AS volatilidad_{w}" for w in features.VOLATILITIES)},
    CAST(i AS DOUBLE) AS trend_lineal, {", ".join(f"{_ewma(n)} AS ewma_{n}" for n in features.SPANS)},
    SUM(change) OVER (s ROWS UNBOUNDED PRECEDING) AS island,
    transacciones / nullif(AVG(transacciones) OVER (s ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 0) AS ratio_transacciones,
    CAST(SUM(CASE WHEN salida > 0 THEN 1 ELSE 0 END) OVER (s ROWS UNBOUNDED PRECEDING) AS BIGINT) AS semana_consecutivas_venta
  FROM (
    SELECT *, row_number() OVER s - 1 AS i,
      CASE WHEN (salida > 0) IS DISTINCT FROM lag(salida > 0) OVER s THEN 1 ELSE 0 END AS change,
      CAST(month(week_start) AS INTEGER) AS mes, CAST(quarter(week_start) AS INTEGER) AS trimestre,
      CAST(isodow(week_start) - 1 AS INTEGER) AS dia_semana, CAST(dayofyear(week_start) AS INTEGER) AS dia_anio,
      CAST(weekofyear(week_start) AS INTEGER) AS num_semana_anio
    FROM dense WINDOW s AS (PARTITION BY sku ORDER BY week_start))
  WINDOW s AS (PARTITION BY sku ORDER BY week_start))""",
)


def _filled(c: str) -> str:
    return (
        f"COALESCE({c}, last_value({c} IGNORE NULLS) OVER b, first_value({c} IGNORE NULLS) OVER a, 0.0) AS {c}"
    )


part(
    "features",
    ("raw_features",),
    f"""
SELECT * REPLACE ({", ".join(_filled(c) for c in features.IMPUTED)}) FROM raw_features
WINDOW b AS (PARTITION BY sku ORDER BY week_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       a AS (PARTITION BY sku ORDER BY week_start ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
)


# --- F -------------------------------------------------------------------------------------------


@query("f1_weekly_totals", sql("SELECT week_start, sales, production FROM weeks", "weeks"))
def f1_weekly_totals(spark, d):
    return weekly.weekly_totals(clean_ledger(spark, d))


@query("f2_weekly_closing_stock", sql("SELECT week_start, closing_stock FROM weeks", "weeks", sku="item"))
def f2_weekly_closing_stock(spark, d):
    return weekly.weekly_closing_stock(clean_ledger(spark, d, sku="item", balance=True), ORDER)


@query("f3_weekly_consolidated", sql("SELECT * FROM weeks", "weeks"))
def f3_weekly_consolidated(spark, d):
    return weekly.weekly_consolidated(clean_ledger(spark, d, balance=True), ORDER)


def brand_weeks(spark, d) -> DataFrame:
    return weekly.weekly_by_sku(clean_ledger(spark, d, balance=True), ORDER)


@query("f4_weekly_by_sku", sql("SELECT * FROM weekly", "weekly"))
def f4_weekly_by_sku(spark, d):
    return brand_weeks(spark, d)


def brand_demand(spark, d, sku="brand", usual=("cliente", "canal", "punto")) -> DataFrame:
    return weekly.weekly_demand(cleaning.sales(clean_ledger(spark, d, sku=sku, parties=bool(usual))), usual)


@query(
    "f5_weekly_demand",
    sql(
        "SELECT * REPLACE (round(salida_promedio, 4) AS salida_promedio, round(salida_std, 4) AS salida_std) FROM demand",
        "demand",
        sku="item",
    ),
)
def f5_weekly_demand(spark, d):
    return rounded(brand_demand(spark, d, "item"), 4, "salida_promedio", "salida_std")


@query(
    "f6_densify_weeks",
    sql("SELECT sku, week_start, iso_year, iso_week, salida, is_imputed FROM gaps", "gaps", sku="item"),
)
def f6_densify_weeks(spark, d):
    dense = weekly.densify_weeks(brand_demand(spark, d, "item", ()))
    return dense.select(*KEYS, "iso_year", "iso_week", "salida", "is_imputed")


@query(
    "f7_interpolate_linear",
    sql("SELECT sku, week_start, round(salida, 8) AS salida FROM dense", "dense", sku="item"),
)
def f7_interpolate_linear(spark, d):
    dense = weekly.interpolate_linear(weekly.densify_weeks(brand_demand(spark, d, "item", ())))
    return rounded(dense.select(*KEYS, "salida"), 8, "salida")


@query(
    "f8_ffill_categories",
    sql("SELECT sku, week_start, cliente_modo, canal_modo, punto_modo FROM dense", "dense", sku="item"),
)
def f8_ffill_categories(spark, d):
    dense = weekly.ffill_categories(weekly.densify_weeks(brand_demand(spark, d, "item")))
    return dense.select(*KEYS, *weekly.MODES)


@query(
    "f9_zero_fill_numeric",
    sql(
        """SELECT sku, week_start, transacciones, round(salida_promedio, 4) AS salida_promedio,
  round(salida_std, 4) AS salida_std, salida_min, salida_max FROM dense""",
        "dense",
        sku="item",
    ),
)
def f9_zero_fill_numeric(spark, d):
    dense = weekly.zero_fill_numeric(weekly.densify_weeks(brand_demand(spark, d, "item", ())))
    return rounded(dense.select(*KEYS, *weekly.NUMERIC), 4, "salida_promedio", "salida_std")


@query(
    "f10_backtest_series",
    sql(
        """SELECT sku, floor(SUM(production) + 0.5) AS produccion_total, floor(SUM(sales) + 0.5) AS ventas_total,
  COUNT(*) AS n_semanas, floor(SUM(sales) / COUNT(*) + 0.5) AS avg_semanal FROM weekly GROUP BY sku""",
        "weekly",
    ),
)
def f10_backtest_series(spark, d):
    return weekly.backtest_series(brand_weeks(spark, d))


TIMELINE = "SELECT week_start, floor(SUM(sales) + 0.5) AS ventas, floor(SUM(production) + 0.5) AS produccion FROM weekly GROUP BY 1"


@query("f10_timeline", sql(TIMELINE, "weekly"))
def f10_timeline(spark, d):
    return weekly.timeline(brand_weeks(spark, d))


@query(
    "f11_monthly_timeline",
    sql(
        f"SELECT strftime(week_start, '%Y-%m') AS mes, SUM(ventas) AS ventas, SUM(produccion) AS produccion FROM ({TIMELINE}) GROUP BY 1",
        "weekly",
    ),
)
def f11_monthly_timeline(spark, d):
    return weekly.monthly_timeline(weekly.timeline(brand_weeks(spark, d)))


# --- G -------------------------------------------------------------------------------------------


def brand_dense(spark, d, usual=()) -> DataFrame:
    return weekly.weekly_dense(brand_demand(spark, d, usual=usual))


def brand_features(spark, d, **kw) -> DataFrame:
    return features.build_features(brand_dense(spark, d), **kw)


def _feature_query(name: str, exact: tuple[str, ...], approximate: tuple[str, ...], build, part_name="raw_features"):
    """Register the columns one feature operator adds; ``approximate`` ones compare at 6 digits."""
    columns = ", ".join(["sku", "week_start", *exact, *[f"round({c}, 6) + 0.0 AS {c}" for c in approximate]])

    @query(name, sql(f"SELECT {columns} FROM {part_name}", part_name))
    def run(spark, d):
        out = build(brand_dense(spark, d)).select(*KEYS, *exact, *approximate)
        return out.withColumns({c: F.round(c, 6) + 0.0 for c in approximate})

    return run


_feature_query("g1_calendar_features", ("mes", "trimestre", "dia_semana", "dia_anio", "num_semana_anio"), (), features.calendar_features)
_feature_query("g2_lags", (), tuple(f"lag_{n}" for n in features.LAGS), features.lags)
_feature_query("g3_moving_average", (), tuple(f"ma_{w}" for w in features.AVERAGES), features.moving_average)
_feature_query("g4_anomaly_flag", ("anomalia_binaria",), (), lambda x: features.anomaly_flag(features.moving_average(x)))
_feature_query("g5_volatility", (), tuple(f"volatilidad_{w}" for w in features.VOLATILITIES), features.volatility)
_feature_query("g6_trend_vs_ma", (), ("trend_vs_ma4", "trend_vs_ma8"), lambda x: features.trend_vs_ma(features.moving_average(x)))
_feature_query("g7_ewma", (), ("ewma_4", "ewma_13"), lambda x: features.ewma(features.linear_trend(features.lags(x))))
_feature_query("g8_linear_trend", ("trend_lineal",), (), features.linear_trend)
_feature_query("g9_run_position", ("semanas_desde_ultima_venta",), (), features.run_position)
_feature_query("g10_yoy_ratio", (), ("yoy_ratio",), features.yoy_ratio)
_feature_query("g11_intra_week_ratios", (), ("ratio_min_max", "variabilidad_intra"), features.intra_week_ratios)
_feature_query("g12_ratio_transactions", (), ("ratio_transacciones",), features.ratio_transactions)
_feature_query("g13_cyclic_encoding", (), ("semana_sin", "semana_cos", "mes_sin", "mes_cos"),
               lambda x: features.cyclic_encoding(features.calendar_features(x)))
_feature_query("g15_cumulative_sale_weeks", ("semana_consecutivas_venta",), (), features.cumulative_sale_weeks)
_feature_query("g16_impute_lags", (), features.IMPUTED, features.build_features, "features")

LONG = " UNION ALL ".join(
    f"SELECT sku, week_start, '{prefix}_' || CAST({c} AS VARCHAR) AS feature, 1 AS value FROM raw_features"
    for c, prefix in features.ONE_HOT.items()
)


@query("g14_one_hot_long", sql(LONG, "raw_features"))
def g14_one_hot_long(spark, d):
    dense = brand_dense(spark, d, ("cliente", "canal", "punto"))
    return features.one_hot_long(features.calendar_features(dense))


def _wide(column: str, alias: str, value: str) -> str:
    return f"""CASE WHEN MAX(CASE WHEN {column} = {value} THEN 1 ELSE 0 END) OVER (PARTITION BY sku) = 1
  THEN CASE WHEN {column} = {value} THEN 1 ELSE 0 END END AS {alias}"""


@query(
    "g14_one_hot_wide",
    sql(
        "SELECT sku, week_start, "
        + ", ".join(
            [_wide("canal_modo", f"canal_{v}", f"'{v}'") for v in ("Online", "Presencial")]
            + [_wide("trimestre", f"trim_{q}", str(q)) for q in (1, 2, 3, 4)]
        )
        + " FROM raw_features",
        "raw_features",
    ),
)
def g14_one_hot_wide(spark, d):
    df = features.calendar_features(brand_dense(spark, d, ("canal",)))
    values = {"canal_modo": ["Online", "Presencial"], "trimestre": [1, 2, 3, 4]}
    wide = features.one_hot(df, values)
    return wide.select(*KEYS, "canal_Online", "canal_Presencial", *[f"trim_{q}" for q in (1, 2, 3, 4)])


FEATURES_SQL = "SELECT " + ", ".join(
    ["sku", "week_start"]
    + [f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in (
        *features.IMPUTED, "mes", "trimestre", "dia_anio", "num_semana_anio", "anomalia_binaria", "trend_vs_ma4",
        "trend_vs_ma8", "trend_lineal", "semanas_desde_ultima_venta", "yoy_ratio", "ratio_min_max",
        "variabilidad_intra", "ratio_transacciones", "semana_sin", "semana_cos", "mes_sin", "mes_cos",
        "semana_consecutivas_venta", "dia_semana")]
) + " FROM features"


@query("g_all_features", sql(FEATURES_SQL, "features"))
def g_all_features(spark, d):
    df = brand_features(spark, d)
    return df.select(*KEYS, *[(F.round(F.col(c).cast("double"), 6) + 0.0).alias(c) for c in features.feature_columns(df)])


# --- K -------------------------------------------------------------------------------------------

STATS = """
SELECT sku, COUNT(*) AS semanas_totales, COUNT(*) FILTER (salida > 0) AS semanas_con_demanda,
  COALESCE(AVG(salida) FILTER (salida > 0), 0.0) AS media_demanda, stddev_samp(salida) FILTER (salida > 0) AS std_demanda,
  COUNT(*) / COUNT(*) FILTER (salida > 0) AS adi,
  stddev_samp(salida) FILTER (salida > 0) / AVG(salida) FILTER (salida > 0) AS cv,
  pow(stddev_samp(salida) FILTER (salida > 0) / AVG(salida) FILTER (salida > 0), 2) AS cv2,
  100 * COUNT(*) FILTER (salida > 0) / COUNT(*) AS pct_semanas_demanda
FROM (SELECT sku, COALESCE(salida, 0.0) AS salida FROM gaps) GROUP BY sku"""
part("adi", ("gaps",), STATS)
part(
    "classes",
    ("adi",),
    """
SELECT *, CASE WHEN cluster IN ('ERRATIC', 'HYBRID_ERRATIC') THEN 'GRUPO_1_ERRATIC' ELSE 'GRUPO_2_INTERMITTENT' END AS grupo
FROM (SELECT *, CASE WHEN adi < 1.32 AND cv2 > 0.49 THEN 'ERRATIC' WHEN adi > 1.32 AND cv2 < 0.49 THEN 'INTERMITTENT'
        WHEN adi < 1.32 THEN 'HYBRID_ERRATIC' ELSE 'HYBRID_INTERMITTENT' END AS cluster FROM adi)""",
)
K_DIGITS = {c: 8 for c in ("media_demanda", "std_demanda", "adi", "cv", "cv2", "pct_semanas_demanda")}
K_REPLACE = "REPLACE (" + ", ".join(f"round({c}, {n}) AS {c}" for c, n in K_DIGITS.items()) + ")"


def classes(spark, d, sku="brand") -> DataFrame:
    dense = weekly.weekly_dense(brand_demand(spark, d, sku, ()), interpolated=False)
    return demand_class.classify_demand(demand_class.adi_cv2(dense))


@query("k1_adi_cv2", sql(f"SELECT * {K_REPLACE} FROM adi", "adi", sku="item"))
def k1_adi_cv2(spark, d):
    out = classes(spark, d, "item").drop("cluster", "grupo")
    return out.withColumns({c: F.round(c, n) for c, n in K_DIGITS.items()})


@query("k2_classify_demand", sql("SELECT sku, round(adi, 8) AS adi, round(cv2, 8) AS cv2, cluster, grupo FROM classes", "classes", sku="item"))
def k2_classify_demand(spark, d):
    return rounded(classes(spark, d, "item").select("sku", "adi", "cv2", "cluster", "grupo"), 8, "adi", "cv2")


@query("k2_classify_brand", sql("SELECT sku, round(adi, 8) AS adi, round(cv2, 8) AS cv2, cluster, grupo FROM classes", "classes"))
def k2_classify_brand(spark, d):
    return rounded(classes(spark, d).select("sku", "adi", "cv2", "cluster", "grupo"), 8, "adi", "cv2")


@query(
    "k3_cluster_summary",
    sql(
        """SELECT grupo, COUNT(*) AS productos, round(AVG(round(adi, 4)), 4) AS adi_promedio,
  round(AVG(round(cv2, 4)), 4) AS cv2_promedio, round(AVG(round(pct_semanas_demanda, 2)), 4) AS pct_semanas_promedio
FROM classes GROUP BY grupo""",
        "classes",
    ),
)
def k3_cluster_summary(spark, d):
    return rounded(
        demand_class.cluster_summary(classes(spark, d)), 4, "adi_promedio", "cv2_promedio", "pct_semanas_promedio"
    )
