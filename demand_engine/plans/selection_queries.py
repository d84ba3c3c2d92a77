"""Checked queries: feature selection (V1-V7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from demand_engine.functions.expressions import rounded
from demand_engine.operators import features, selection
from demand_engine.plans.registry import part, query, sql
from demand_engine.plans.series_queries import LONG, brand_dense
from demand_engine.plans.series_queries import brand_features as lazy_features
from demand_engine.session import keep_table


def brand_features(spark, d):
    """The feature table, written once: means and moments are two passes over it."""
    return keep_table(lazy_features(spark, d), "features")


NAMES = sorted(
    (*features.IMPUTED, "mes", "trimestre", "dia_semana", "dia_anio", "num_semana_anio", "anomalia_binaria",
     "trend_vs_ma4", "trend_vs_ma8", "trend_lineal", "semanas_desde_ultima_venta", "yoy_ratio", "ratio_min_max",
     "variabilidad_intra", "ratio_transacciones", "semana_sin", "semana_cos", "mes_sin", "mes_cos",
     "semana_consecutivas_venta")
)


def _corr(a: str, b: str) -> str:
    """Correlation, null when a column is constant."""
    return f"CASE WHEN stddev_pop({a}) > 1e-9 AND stddev_pop({b}) > 1e-9 THEN corr({a}, {b}) END"


def _matrix_sql(pairs: list[tuple[str, str]]) -> str:
    """All correlations in one scan, then one row per pair."""
    wide = ", ".join(f"{_corr(a, b)} AS c{i}" for i, (a, b) in enumerate(pairs))
    rows = ", ".join(f"{{'a': '{a}', 'b': '{b}', 'r': c{i}}}" for i, (a, b) in enumerate(pairs))
    return f"SELECT unnest([{rows}], recursive := true) FROM (SELECT {wide} FROM features)"


PAIRS = [(a, b) for a in NAMES for b in NAMES if a < b]


@query(
    "v1_correlation_matrix",
    sql(f"SELECT a, b, round(r, 6) + 0.0 AS r FROM ({_matrix_sql(PAIRS)})", "features"),
)
def v1_correlation_matrix(spark, d):
    matrix = selection.correlation_matrix(brand_features(spark, d), NAMES)
    return matrix.where("a < b").select("a", "b", (F.round("r", 6) + 0.0).alias("r"))


@query(
    "v2_high_corr_pairs",
    sql(f"SELECT a, b, round(r, 6) + 0.0 AS r FROM ({_matrix_sql(PAIRS)}) WHERE abs(r) > 0.90", "features"),
)
def v2_high_corr_pairs(spark, d):
    pairs = selection.high_corr_pairs(selection.correlation_matrix(brand_features(spark, d), NAMES), 0.90)
    return pairs.withColumn("r", F.round("r", 6) + 0.0)


@query("v3_vif")
def v3_vif(spark, d):
    return rounded(selection.vif(brand_features(spark, d)), 4, "vif")


THREE = ("lag_1", "ma_4", "volatilidad_4")


part(
    "vif_three",
    ("features",),
    """SELECT unnest([{'feature': 'lag_1', 'vif': aa * (bb * cc - bc * bc) / det}, {'feature': 'ma_4', 'vif': bb * (aa * cc - ac * ac) / det},
  {'feature': 'volatilidad_4', 'vif': cc * (aa * bb - ab * ab) / det}], recursive := true)
FROM (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM (
  SELECT SUM(a * a) AS aa, SUM(b * b) AS bb, SUM(c * c) AS cc, SUM(a * b) AS ab, SUM(a * c) AS ac, SUM(b * c) AS bc
  FROM (SELECT lag_1 AS a, ma_4 AS b, volatilidad_4 AS c FROM features)))""",
)


def three_features(spark, d):
    return brand_features(spark, d).select(*features.KEYS, *THREE)


@query("v3_vif_three_features", sql("SELECT feature, round(vif, 4) AS vif FROM vif_three", "vif_three"))
def v3_vif_three_features(spark, d):
    return rounded(selection.vif(brand_features(spark, d), list(THREE)), 4, "vif")


@query(
    "v5_sets_of_three_features",
    sql(
        """SELECT feature_set, feature FROM (SELECT feature FROM vif_three WHERE vif <= 10), (SELECT unnest(['conservative', 'intermediate', 'aggressive']) AS feature_set)
WHERE feature_set = 'aggressive' OR feature <> 'ma_4'""",
        "vif_three",
    ),
)
def v5_sets_of_three_features(spark, d):
    """All three tell of the past; of the averages the narrower sets keep two others."""
    df = three_features(spark, d)
    return selection.set_members(features.feature_columns(df), selection.problem_features(selection.vif(df)), spark)


@query(
    "v6_summary_of_three_features",
    sql(
        f"""SELECT total_registros, pares_095, pares_090, features_problema, 3 AS total_features, 3 AS n_pasado, 0 AS n_futuro, 0 AS n_temporal,
  CAST(3 - features_problema AS INTEGER) AS n_aggressive, CAST(narrow AS INTEGER) AS n_conservative, CAST(narrow AS INTEGER) AS n_intermediate
FROM (SELECT COUNT(*) AS total_registros FROM features),
  (SELECT COUNT(*) FILTER (abs(r) > 0.95) AS pares_095, COUNT(*) FILTER (abs(r) > 0.90) AS pares_090
   FROM ({_matrix_sql([(a, b) for a in THREE for b in THREE if a < b])})),
  (SELECT COUNT(*) FILTER (vif > 10) AS features_problema, COUNT(*) FILTER (vif <= 10 AND feature <> 'ma_4') AS narrow FROM vif_three)""",
        "vif_three",
    ),
)
def v6_summary_of_three_features(spark, d):
    df = three_features(spark, d)
    return selection.selection_summary(df, selection.correlation_matrix(df), selection.vif(df))


@query("v7_top_vif_of_three_features", sql("SELECT feature, round(vif, 4) AS vif FROM vif_three ORDER BY vif_three.vif DESC LIMIT 2", "vif_three"))
def v7_top_vif_of_three_features(spark, d):
    return rounded(selection.top_by(selection.vif(brand_features(spark, d), list(THREE)), "vif", 2), 4, "vif")


TARGET = _matrix_sql([(c, "salida") for c in NAMES])


@query(
    "v4_target_correlation",
    sql(
        f"SELECT a AS feature, round(COALESCE(r, 0.0), 6) + 0.0 AS correlacion, round(abs(COALESCE(r, 0.0)), 6) AS abs_corr FROM ({TARGET})",
        "features",
    ),
)
def v4_target_correlation(spark, d):
    out = selection.target_correlation(brand_features(spark, d), NAMES).drop("pvalor")
    return out.withColumns({"correlacion": F.round("correlacion", 6) + 0.0, "abs_corr": F.round("abs_corr", 6)})


# Student's t for whole degrees of freedom v as a finite series in s = |r| and c2 = 1 - r^2: the share of the distribution within t.
P_VALUE = """CASE WHEN r IS NULL OR v <= 0 THEN 1.0 WHEN c2 <= 0 THEN 0.0 WHEN v % 2 = 0 THEN
  1 - s * list_sum(list_transform(range(0, v // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1.0) - 0.5 * ln(pi()) + j * ln(c2))))
ELSE 1 - 2 / pi() * (asin(s) + CASE WHEN v = 1 THEN 0.0 ELSE s * list_sum(list_transform(range(0, (v - 1) // 2),
  lambda j: exp(0.5 * ln(pi()) - ln(2.0) + lgamma(j + 1.0) - lgamma(j + 1.5) + (j + 0.5) * ln(c2)))) END) END"""


@query(
    "v4_target_p_values",
    sql(
        f"""SELECT feature, round(COALESCE(r, 0.0), 6) + 0.0 AS correlacion, round(abs(COALESCE(r, 0.0)), 6) AS abs_corr, round(abs({P_VALUE}), 6) AS pvalor
FROM (SELECT a AS feature, r, abs(r) AS s, 1 - r * r AS c2, (SELECT COUNT(*) - 2 FROM features) AS v FROM ({TARGET}))""",
        "features",
    ),
)
def v4_target_p_values(spark, d):
    out = selection.target_correlation(brand_features(spark, d), NAMES)
    return out.withColumns({"correlacion": F.round("correlacion", 6) + 0.0, "abs_corr": F.round("abs_corr", 6), "pvalor": F.abs(F.round("pvalor", 6))})


@query("v5_feature_sets")
def v5_feature_sets(spark, d):
    df = brand_features(spark, d)
    return selection.select_sets(df, selection.vif(df))["intermediate"]


@query("v6_selection_summary")
def v6_selection_summary(spark, d):
    df = brand_features(spark, d)
    return selection.selection_summary(df, selection.correlation_matrix(df), selection.vif(df))


@query(
    "v7_top_target_list",
    sql(
        f"""SELECT a AS feature, round(COALESCE(r, 0.0), 6) + 0.0 AS correlacion
FROM ({TARGET}) ORDER BY round(abs(COALESCE(r, 0.0)), 8) DESC, a LIMIT 25""",
        "features",
    ),
)
def v7_top_target_list(spark, d):
    table = selection.target_correlation(brand_features(spark, d), NAMES).withColumn("abs_corr", F.round("abs_corr", 8))
    top = selection.top_by(table, "abs_corr", 25)
    return top.select("feature", (F.round("correlacion", 6) + 0.0).alias("correlacion"))


@query(
    "v7_top_correlation_matrix",
    sql(
        f"""
, top AS (SELECT a FROM ({TARGET}) ORDER BY round(abs(COALESCE(r, 0.0)), 8) DESC, a LIMIT 30)
SELECT a, b, round(r, 6) + 0.0 AS r FROM ({_matrix_sql(PAIRS)}) WHERE a IN (SELECT a FROM top) AND b IN (SELECT a FROM top)""",
        "features",
    ),
)
def v7_top_correlation_matrix(spark, d):
    df = brand_features(spark, d)
    table = selection.target_correlation(df, NAMES).withColumn("abs_corr", F.round("abs_corr", 8))
    top = [r["feature"] for r in selection.top_by(table, "abs_corr", 30).collect()]
    return selection.correlation_matrix(df, top).where("a < b").select("a", "b", (F.round("r", 6) + 0.0).alias("r"))


@query("v7_top_vif_list")
def v7_top_vif_list(spark, d):
    return rounded(selection.top_by(selection.vif(brand_features(spark, d)), "vif", 20), 4, "vif")


# Indicators of client, channel, point of sale and quarter: 0 in the other weeks of the SKUs that ever have them.
part("indicators", ("raw_features",), LONG)
part(
    "indicator_rows",
    ("indicators", "raw_features"),
    """
SELECT h.feature, r.sku, r.week_start, r.salida, r.ma_4, CASE WHEN i.feature IS NULL THEN 0 ELSE 1 END AS v
FROM (SELECT DISTINCT sku, feature FROM indicators) h JOIN (SELECT sku, week_start, salida, COALESCE(ma_4, 0.0) AS ma_4 FROM raw_features) r USING (sku)
LEFT JOIN indicators i ON i.sku = h.sku AND i.feature = h.feature AND i.week_start = r.week_start""",
)
FEW = "feature LIKE 'canal%' OR feature LIKE 'trim%' OR feature LIKE 'punto%'"


def indicators_of(spark, d):
    """The dense series of all brands, and its indicators, both written once."""
    dense = keep_table(features.calendar_features(brand_dense(spark, d, ("cliente", "canal", "punto"))), "dense")
    return dense, keep_table(features.one_hot_long(dense), "indicators")


@query(
    "v4_indicator_target",
    sql(
        f"""SELECT feature, round(COALESCE(r, 0.0), 6) + 0.0 AS correlacion, round(abs(COALESCE(r, 0.0)), 6) AS abs_corr, round(abs({P_VALUE}), 6) AS pvalor
FROM (SELECT feature, r, abs(r) AS s, 1 - r * r AS c2, v FROM (SELECT feature, {_corr("v", "salida")} AS r, COUNT(*) - 2 AS v FROM indicator_rows GROUP BY feature))""",
        "indicator_rows",
    ),
)
def v4_indicator_target(spark, d):
    dense, indicators = indicators_of(spark, d)
    out = selection.indicator_target(indicators, dense)
    return out.withColumns({"correlacion": F.round("correlacion", 6) + 0.0, "abs_corr": F.round("abs_corr", 6), "pvalor": F.abs(F.round("pvalor", 6))})


@query(
    "v1_indicator_pairs",
    sql(
        f"""SELECT x.feature AS a, y.feature AS b, COUNT(*) AS n, round({_corr("x.v", "y.v")}, 6) + 0.0 AS r
FROM (SELECT * FROM indicator_rows WHERE {FEW}) x JOIN (SELECT * FROM indicator_rows WHERE {FEW}) y ON x.sku = y.sku AND x.week_start = y.week_start AND x.feature < y.feature
GROUP BY 1, 2 UNION ALL SELECT feature, c, COUNT(*), round(corr, 6) + 0.0 FROM (
  SELECT feature, 'salida' AS c, {_corr("v", "salida")} AS corr, unnest(range(COUNT(*))) FROM indicator_rows WHERE {FEW} GROUP BY feature) GROUP BY ALL""",
        "indicator_rows",
    ),
)
def v1_indicator_pairs(spark, d):
    dense, indicators = indicators_of(spark, d)
    few = indicators.where("feature LIKE 'canal%' OR feature LIKE 'trim%' OR feature LIKE 'punto%'")
    return selection.indicator_correlation(few, dense, ["salida"]).withColumn("r", F.round("r", 6) + 0.0)
