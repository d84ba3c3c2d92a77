"""Checked queries: folds, scores, winners, forecasts (W, X).

Where SQL must follow along, the scored "models" are features that are forecasts by themselves (last
week, moving averages); the fitted models are checked against numpy in the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demand_engine.functions.expressions import rounded
from demand_engine.operators import cleaning, demand_class, features, forecast, models, weekly
from demand_engine.plans.registry import PARTS, part, query, sql
from demand_engine.plans.series_queries import brand_dense, brand_features, classes
from demand_engine.session import keep_table

NAIVE = ("lag_1", "ma_4", "ma_13")
part(
    "folds",
    ("features",),
    f"""
SELECT sku, week_start, salida, {", ".join(NAIVE)}, canal_modo, fold, i < n - (k - fold) * size AS is_train
FROM (SELECT *, CAST(unnest(generate_series(0, k - 1)) AS INTEGER) AS fold FROM (
  SELECT *, n // (k + 1) AS size FROM (
    SELECT *, least(5, greatest(2, n // 4)) AS k FROM (
      SELECT *, row_number() OVER (PARTITION BY sku ORDER BY week_start) - 1 AS i, COUNT(*) OVER (PARTITION BY sku) AS n
      FROM features))))
WHERE i < n - (k - fold - 1) * size""",
)
part(
    "naive",
    ("folds",),
    " UNION ALL ".join(
        f"SELECT sku, '{a}' AS algorithm, fold, salida AS y, {a} AS yhat FROM folds WHERE NOT is_train" for a in NAIVE
    ),
)
part(
    "fold_scores",
    ("naive",),
    """
SELECT sku, algorithm, fold, CASE WHEN tot > 0 THEN 1 - res / tot WHEN res = 0 THEN 1.0 ELSE 0.0 END AS r2, mae, rmse, mape
FROM (SELECT sku, algorithm, fold, SUM((y - yhat) * (y - yhat)) AS res, var_pop(y) * COUNT(*) AS tot,
  AVG(abs(y - yhat)) AS mae, sqrt(AVG((y - yhat) * (y - yhat))) AS rmse,
  COALESCE(AVG(least(200.0, abs((y - yhat) / y) * 100)) FILTER (y > 0), 0.0) AS mape FROM naive GROUP BY ALL)""",
)
part(
    "mean_scores",
    ("fold_scores",),
    """SELECT sku, algorithm, AVG(r2) AS r2, AVG(mae) AS mae, AVG(rmse) AS rmse, AVG(mape) AS mape
FROM fold_scores GROUP BY sku, algorithm""",
)
part(
    "winners",
    ("mean_scores",),
    """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY r2 DESC,
  CASE algorithm WHEN 'lag_1' THEN 0 WHEN 'ma_4' THEN 1 ELSE 2 END) AS rn FROM mean_scores) WHERE rn = 1""",
)
METRICS = ("r2", "mae", "rmse", "mape")
ROUNDED = ", ".join(f"round({m}, 6) + 0.0 AS {m}" for m in METRICS)


def naive_predictions(spark, d) -> DataFrame:
    tests = models.time_series_folds(brand_features(spark, d)).where(~F.col("is_train"))
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("algorithm"), F.col(a).alias("yhat")) for a in NAIVE]))
    return tests.select("sku", "fold", F.col("salida").alias("y"), pairs.alias("_p")).select(
        "sku", "_p.algorithm", F.lit(0).alias("candidate"), "fold", "y", "_p.yhat"
    )


def naive_best(spark, d) -> DataFrame:
    return models.best_candidates(models.mean_scores(models.score_folds(naive_predictions(spark, d))))


def _round(df):
    return df.withColumns({m: F.round(m, 6) + 0.0 for m in METRICS})


def critical_features(spark, d) -> DataFrame:
    """Feature rows of the SKUs of the first demand group, written for the model search."""
    group = classes(spark, d).where(F.col("grupo") == demand_class.GROUP_1)
    rows = features.build_features(brand_dense(spark, d, ("cliente", "canal", "punto")))
    return keep_table(cleaning.critical_only(rows, group), "critical")


EVERY = [c for c in features.ROLES if c not in features.LEAKING]


@query("w1_usable_features", sql(f"""SELECT DISTINCT sku, unnest({EVERY}) AS feature, CAST(NULL AS VARCHAR) AS error FROM features""", "features"))
def w1_usable_features(spark, d):
    df = brand_features(spark, d).withColumn("texto", F.lit("abc"))
    return models.usable_features(df, [*EVERY, "texto"])


@query("w2_time_series_folds", sql("SELECT sku, week_start, fold, is_train FROM folds", "folds"))
def w2_time_series_folds(spark, d):
    return models.time_series_folds(brand_dense(spark, d)).select("sku", "week_start", "fold", "is_train")


def _model_columns(df):
    return features.feature_columns(df, leak_safe=True)


def _scores(spark, d, grid):
    df = critical_features(spark, d)
    return models.score_folds(models.cross_validate(df, _model_columns(df), grid, weekly.MODES))


@query("w3_ridge_grid")
def w3_ridge_grid(spark, d):
    return _round(_scores(spark, d, models.FULL_GRID))


TWO = ("lag_1", "ma_4")
# Ridge on two columns in closed form: the centred sums of the training rows and a 2 x 2 system for each penalty.
part(
    "ridge_two",
    ("folds",),
    f"""
SELECT sku, candidate, fold, week_start, y, ym + w1 * (x1 - m1) + w2 * (x2 - m2) AS yhat
FROM (SELECT sku, fold, week_start, salida AS y, COALESCE(lag_1, 0.0) AS x1, COALESCE(ma_4, 0.0) AS x2 FROM folds WHERE NOT is_train)
JOIN (
  SELECT *, (s1y * (s22 + alpha) - s2y * s12) / ((s11 + alpha) * (s22 + alpha) - s12 * s12) AS w1,
    (s2y * (s11 + alpha) - s1y * s12) / ((s11 + alpha) * (s22 + alpha) - s12 * s12) AS w2
  FROM (
    SELECT sku, fold, AVG(x1) AS m1, AVG(x2) AS m2, AVG(y) AS ym, COUNT(*) * var_pop(x1) AS s11, COUNT(*) * var_pop(x2) AS s22,
      COUNT(*) * covar_pop(x1, x2) AS s12, COUNT(*) * covar_pop(x1, y) AS s1y, COUNT(*) * covar_pop(x2, y) AS s2y
    FROM (SELECT sku, fold, salida AS y, COALESCE(lag_1, 0.0) AS x1, COALESCE(ma_4, 0.0) AS x2 FROM folds WHERE is_train) GROUP BY ALL),
    (VALUES {", ".join(f"({i}, {a}::DOUBLE)" for i, a in enumerate(models.RIDGE_GRID["alpha"]))}) t(candidate, alpha)) USING (sku, fold)""",
)


@query("w3_ridge_two_features", sql("SELECT sku, candidate, fold, week_start, round(yhat, 4) + 0.0 AS yhat FROM ridge_two", "ridge_two"))
def w3_ridge_two_features(spark, d):
    found = models.cross_validate(brand_features(spark, d), list(TWO))
    return found.select("sku", "candidate", "fold", "week_start", (F.round("yhat", 4) + 0.0).alias("yhat"))


X1, X2 = "COALESCE(lag_1, 0.0) AS x1", "COALESCE(ma_4, 0.0) AS x2"
part("ridge_channel", ("folds",), PARTS["ridge_two"].replace(X1, "CAST(canal_modo = 'Online' AS DOUBLE) AS x1").replace(X2, "CAST(canal_modo = 'Presencial' AS DOUBLE) AS x2"))


@query("w3_ridge_channel", sql("SELECT sku, candidate, fold, week_start, round(yhat, 4) + 0.0 AS yhat FROM ridge_channel", "ridge_channel"))
def w3_ridge_channel(spark, d):
    """The two indicators of the channel alone."""
    found = models.cross_validate(brand_dense(spark, d, ("canal",)), [], categories=("canal_modo",))
    return found.select("sku", "candidate", "fold", "week_start", (F.round("yhat", 4) + 0.0).alias("yhat"))


# Scores of the fitted models: every penalty of the grid, the best one of each SKU.
part(
    "ridge_folds",
    ("ridge_two",),
    PARTS["fold_scores"].replace("algorithm", "candidate").replace("FROM naive", "FROM ridge_two"),
)
part("ridge_scores", ("ridge_folds",), PARTS["mean_scores"].replace("algorithm", "candidate").replace("fold_scores", "ridge_folds"))
part(
    "ridge_best",
    ("ridge_scores",),
    f"""SELECT sku, 'Ridge' AS algorithm, candidate, r2, mae, rmse, mape, alpha
FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY r2 DESC, candidate) AS rn FROM ridge_scores)
JOIN (VALUES {", ".join(f"({i}, {a}::DOUBLE)" for i, a in enumerate(models.RIDGE_GRID["alpha"]))}) t(candidate, alpha) USING (candidate) WHERE rn = 1""",
)


def ridge_search(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Features of all brands, and the best candidates and winners of a search on two of them."""
    df = brand_features(spark, d)
    return df, *models.search(df, list(TWO))


@query("w6_ridge_winner", sql(f"SELECT sku, algorithm, candidate, {ROUNDED}, alpha FROM ridge_best", "ridge_best"))
def w6_ridge_winner(spark, d):
    winners = ridge_search(spark, d)[2]
    return _round(winners.withColumn("alpha", F.col("params")["alpha"]).drop("params"))


@query("w7_ridge_metrics", sql(f"SELECT sku, 'Ridge' AS algorithm, candidate, {ROUNDED} FROM ridge_scores", "ridge_scores"))
def w7_ridge_metrics(spark, d):
    return _round(models.mean_scores(models.score_folds(models.cross_validate(brand_features(spark, d), list(TWO)))))


@query("w8_ridge_fold_scores", sql(f"SELECT sku, 'Ridge' AS algorithm, candidate, fold, {ROUNDED} FROM ridge_folds", "ridge_folds"))
def w8_ridge_fold_scores(spark, d):
    return _round(models.score_folds(models.cross_validate(brand_features(spark, d), list(TWO))))


@query("w9_ridge_comparison", sql('SELECT sku, round(r2, 6) + 0.0 AS "Ridge" FROM ridge_best', "ridge_best"))
def w9_ridge_comparison(spark, d):
    return models.model_comparison(ridge_search(spark, d)[1]).withColumn("Ridge", F.round("Ridge", 6) + 0.0)


@query("w6_select_winner", sql(f"SELECT sku, algorithm, 0 AS candidate, {ROUNDED} FROM winners", "winners"))
def w6_select_winner(spark, d):
    return _round(models.select_winner(naive_best(spark, d), NAIVE))


@query("w7_cv_metrics", sql(f"SELECT sku, algorithm, 0 AS candidate, {ROUNDED} FROM mean_scores", "mean_scores"))
def w7_cv_metrics(spark, d):
    return _round(models.mean_scores(models.score_folds(naive_predictions(spark, d))))


@query("w8_fold_scores", sql(f"SELECT sku, algorithm, 0 AS candidate, fold, {ROUNDED} FROM fold_scores", "fold_scores"))
def w8_fold_scores(spark, d):
    return _round(models.score_folds(naive_predictions(spark, d)))


@query(
    "w9_model_comparison",
    sql(
        "SELECT sku, " + ", ".join(f"round(MAX(r2) FILTER (algorithm = '{a}'), 6) + 0.0 AS {a}" for a in NAIVE)
        + " FROM mean_scores GROUP BY sku",
        "mean_scores",
    ),
)
def w9_model_comparison(spark, d):
    out = models.model_comparison(naive_best(spark, d), NAIVE)
    return out.withColumns({a: F.round(a, 6) + 0.0 for a in NAIVE})


@query(
    "w9_winner_tally",
    sql(
        """SELECT algorithm, wins, row_number() OVER (ORDER BY wins DESC, algorithm) = 1 AS most_frequent
FROM (SELECT algorithm, COUNT(*) AS wins FROM winners GROUP BY algorithm)""",
        "winners",
    ),
)
def w9_winner_tally(spark, d):
    return models.winner_tally(models.select_winner(naive_best(spark, d), NAIVE))


@query("w9_mean_r2", sql("SELECT algorithm, round(AVG(r2), 6) + 0.0 AS mean_r2 FROM mean_scores GROUP BY 1", "mean_scores"))
def w9_mean_r2(spark, d):
    return models.mean_r2(naive_best(spark, d)).withColumn("mean_r2", F.round("mean_r2", 6) + 0.0)


# --- X -------------------------------------------------------------------------------------------

part(
    "season",
    ("dense",),
    """
SELECT sku, iso_week, greatest(0.2, least(4.0, m / a)) AS factor FROM (
  SELECT sku, CAST(weekofyear(week_start) AS INTEGER) AS iso_week, AVG(salida) AS m FROM dense GROUP BY ALL)
JOIN (SELECT sku, AVG(salida) AS a FROM dense GROUP BY sku) USING (sku) WHERE a > 0""",
)
part(
    "recent",
    ("dense",),
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY week_start DESC) AS rn FROM dense) WHERE rn <= 104",
)
# Level x season: the mean of the training window times the week's factor.
part(
    "steps",
    ("recent", "season"),
    """
SELECT sku, h, week_start, greatest(0.0, raw * COALESCE(factor, 1.0)) AS prediction, sigma
FROM (SELECT sku, CAST(h AS INTEGER) AS h, CAST(last_week + 7 * CAST(h AS INTEGER) AS DATE) AS week_start, raw, sigma
      FROM (SELECT sku, MAX(week_start) AS last_week, AVG(salida) AS raw, stddev_samp(salida) AS sigma FROM recent GROUP BY sku),
           generate_series(1, 52) t(h))
LEFT JOIN season USING (sku) WHERE iso_week = weekofyear(week_start) OR iso_week IS NULL""",
)
part(
    "forecast",
    ("steps",),
    """
SELECT sku, h, week_start, round(prediction, 2) AS prediction,
  round(greatest(0.0, prediction - 1.96::DOUBLE * sigma * sqrt(h)), 2) AS lower, round(prediction + 1.96::DOUBLE * sigma * sqrt(h), 2) AS upper
FROM steps""",
)


def level_forecast(dense: DataFrame) -> DataFrame:
    """Forecast that SQL can repeat: mean of the training window x seasonal factor."""
    recent = forecast.training_window(dense)
    level = recent.groupBy("sku").agg(
        F.max("week_start").alias("_last"), F.mean("salida").alias("raw"), F.stddev_samp("salida").alias("sigma")
    )
    steps = level.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(forecast.HORIZON)))).withColumn(
        "week_start", F.date_add("_last", F.col("h") * 7)
    )
    return forecast.forecast_interval(forecast.apply_season(steps, forecast.seasonal_index(dense)))


@query("x1_training_window", sql("SELECT sku, week_start, round(salida, 8) AS salida FROM recent", "recent"))
def x1_training_window(spark, d):
    return rounded(forecast.training_window(brand_dense(spark, d)).select("sku", "week_start", "salida"), 8, "salida")


@query("x3_seasonal_index", sql("SELECT sku, iso_week, round(factor, 8) AS factor FROM season", "season"))
def x3_seasonal_index(spark, d):
    return rounded(forecast.seasonal_index(brand_dense(spark, d)), 8, "factor")


@query("x5_forecast_interval", sql("SELECT * FROM forecast", "forecast"))
def x5_forecast_interval(spark, d):
    return level_forecast(brand_dense(spark, d))


@query(
    "x6_forecast_pivot",
    sql("SELECT h, 'W+' || CAST(h AS VARCHAR) AS semana, * EXCLUDE (h) FROM (PIVOT (SELECT h, sku, prediction FROM forecast) ON sku USING MAX(prediction) GROUP BY h)",
        "forecast"),
)
def x6_forecast_pivot(spark, d):
    return forecast.forecast_pivot(keep_table(level_forecast(brand_dense(spark, d)), "forecast"))


def _fits(df, columns, categories=()):
    """Feature rows, winners, final fits and the columns of a search."""
    _, winners = models.search(df, columns, categories=categories)
    return df, winners, keep_table(forecast.fit_final(df, winners, columns, categories=categories), "fitted"), columns


def _fitted(spark, d):
    """All columns that don't leak, and client, channel and point of sale."""
    df = critical_features(spark, d)
    return _fits(df, _model_columns(df), weekly.MODES)


def fitted_two(spark, d):
    return _fits(keep_table(brand_features(spark, d), "features"), list(TWO))


@query("x2_residual_stats")
def x2_residual_stats(spark, d):
    return forecast.residual_stats(_fitted(spark, d)[2])


@query("x4_recursive_forecast")
def x4_recursive_forecast(spark, d):
    return forecast.recursive_forecast(*_fitted(spark, d))


@query("x7_forecast_metadata")
def x7_forecast_metadata(spark, d):
    _, winners, fitted, _ = _fitted(spark, d)
    return forecast.forecast_metadata(winners, fitted)


# The same on two features of all brands: the final fit in closed form, the recursion as a recursive query.
part(
    "train_two",
    ("features",),
    """SELECT sku, week_start, salida AS y, COALESCE(lag_1, 0.0) AS x1, COALESCE(ma_4, 0.0) AS x2
FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY week_start DESC) AS rn FROM features) WHERE rn <= 104""",
)
part(
    "fit_two",
    ("train_two", "ridge_best"),
    """
SELECT sku, algorithm, last_week, w1, w2, ym - w1 * m1 - w2 * m2 AS w0, sales_std, r2, mae, rmse, mape FROM (
  SELECT *, (s1y * (s22 + alpha) - s2y * s12) / ((s11 + alpha) * (s22 + alpha) - s12 * s12) AS w1,
    (s2y * (s11 + alpha) - s1y * s12) / ((s11 + alpha) * (s22 + alpha) - s12 * s12) AS w2
  FROM (
    SELECT sku, MAX(week_start) AS last_week, AVG(x1) AS m1, AVG(x2) AS m2, AVG(y) AS ym, COUNT(*) * var_pop(x1) AS s11,
      COUNT(*) * var_pop(x2) AS s22, COUNT(*) * covar_pop(x1, x2) AS s12, COUNT(*) * covar_pop(x1, y) AS s1y,
      COUNT(*) * covar_pop(x2, y) AS s2y, COALESCE(stddev_samp(y), 50.0) AS sales_std
    FROM train_two GROUP BY sku) JOIN ridge_best USING (sku))""",
)
part("left_two", ("train_two", "fit_two"), "SELECT sku, week_start, y - (w0 + w1 * x1 + w2 * x2) AS residual FROM train_two JOIN fit_two USING (sku)")
part(
    "stats_two",
    ("left_two", "fit_two"),
    """SELECT sku, any_value(algorithm) AS algorithm, AVG(residual) AS resid_mean, stddev_samp(residual) AS resid_std,
  any_value(sales_std) AS sales_std FROM left_two JOIN fit_two USING (sku) GROUP BY sku""",
)
part(
    "ahead_two",
    ("train_two", "fit_two"),
    """
SELECT sku, 0 AS h, (SELECT list(t.y ORDER BY t.week_start DESC)[1:4] FROM train_two t WHERE t.sku = f.sku) AS past, 0.0::DOUBLE AS raw FROM fit_two f
UNION ALL
SELECT sku, h + 1, list_prepend(y, past)[1:4], y FROM (
  SELECT a.sku, a.h, a.past, greatest(0.0, f.w0 + f.w1 * a.past[1] + f.w2 * list_avg(a.past)) AS y
  FROM ahead_two a JOIN fit_two f ON f.sku = a.sku WHERE a.h < 52)""",
)
part(
    "forecast_two",
    ("ahead_two", "fit_two", "stats_two", "season"),
    """
SELECT sku, h, week_start, round(prediction, 2) AS prediction, round(greatest(0.0, prediction - 1.96::DOUBLE * sigma * sqrt(h)), 2) AS lower,
  round(prediction + 1.96::DOUBLE * sigma * sqrt(h), 2) AS upper
FROM (
  SELECT a.sku, CAST(a.h AS INTEGER) AS h, a.week_start, greatest(0.0, a.raw * COALESCE(s.factor, 1.0)) AS prediction,
    CASE WHEN f.rmse > 0 THEN f.rmse WHEN f.rmse IS NULL AND t.resid_std > 0 THEN t.resid_std ELSE f.sales_std END AS sigma
  FROM (SELECT x.sku, x.h, x.raw, CAST(y.last_week + 7 * CAST(x.h AS INTEGER) AS DATE) AS week_start FROM ahead_two x JOIN fit_two y USING (sku) WHERE h > 0) a
  JOIN fit_two f ON f.sku = a.sku JOIN stats_two t ON t.sku = a.sku
  LEFT JOIN season s ON s.sku = a.sku AND s.iso_week = weekofyear(a.week_start))""",
)
STATS = ("resid_mean", "resid_std", "sales_std")
STATS_ROUNDED = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in STATS)


def _round_stats(df):
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in STATS})


@query("x2_residual_stats_two_features", sql(f"SELECT sku, algorithm, {STATS_ROUNDED} FROM stats_two", "stats_two"))
def x2_residual_stats_two_features(spark, d):
    return _round_stats(forecast.residual_stats(fitted_two(spark, d)[2]).drop("residuals"))


@query(
    "x2_residuals_two_features",
    sql("SELECT sku, CAST(row_number() OVER (PARTITION BY sku ORDER BY week_start) - 1 AS INTEGER) AS week, round(residual, 6) + 0.0 AS residual FROM left_two", "left_two"),
)
def x2_residuals_two_features(spark, d):
    stats = forecast.residual_stats(fitted_two(spark, d)[2])
    return stats.select("sku", F.posexplode("residuals").alias("week", "r")).select("sku", "week", (F.round("r", 6) + 0.0).alias("residual"))


@query("x4_recursion_two_features", sql("SELECT sku, CAST(h AS INTEGER) AS h, round(raw, 6) + 0.0 AS raw FROM ahead_two WHERE h > 0", "ahead_two"))
def x4_recursion_two_features(spark, d):
    _, _, fitted, columns = fitted_two(spark, d)
    return forecast.unroll(fitted, columns).select("sku", "h", (F.round("raw", 6) + 0.0).alias("raw"))


@query("x4_forecast_two_features", sql("SELECT * FROM forecast_two", "forecast_two"))
def x4_forecast_two_features(spark, d):
    return forecast.recursive_forecast(*fitted_two(spark, d))


@query(
    "x7_metadata_two_features",
    sql(f"SELECT sku, algorithm, {ROUNDED}, {STATS_ROUNDED}, n FROM fit_two f JOIN (SELECT sku, resid_mean, resid_std FROM stats_two) USING (sku) "
        "JOIN (SELECT sku, COUNT(*) AS n FROM left_two GROUP BY sku) USING (sku)", "fit_two", "stats_two", "left_two"),
)
def x7_metadata_two_features(spark, d):
    _, winners, fitted, _ = fitted_two(spark, d)
    found = forecast.forecast_metadata(winners, fitted).withColumn("n", F.size("residuals").cast("long")).drop("residuals")
    return _round_stats(_round(found))
