import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from demand_engine.functions.regressors import Ridge
from demand_engine.operators import features, forecast, models
from test_weekly_features import dense_of

FITTED = "sku string, last_week date, intercept double, weights array<double>, latest array<double>, standing double, tail array<double>"
SMALL = {"Ridge": {"alpha": [1.0, 10.0]}}


def test_ridge_solves_the_penalised_equations():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(40, 5)), rng.normal(size=40)
    xc, yc = x - x.mean(0), y - y.mean()
    stacked = np.vstack([xc, math.sqrt(3.0) * np.eye(5)])
    w = np.linalg.lstsq(stacked, np.concatenate([yc, np.zeros(5)]), rcond=None)[0]
    np.testing.assert_allclose(Ridge(3.0).fit(x, y).predict(x), xc @ w + y.mean())


@pytest.mark.parametrize("n", [3, 8, 9, 24, 104])
def test_folds(series, n):
    out = models.time_series_folds(series({"a": range(n)})).collect()
    bounds = models.fold_bounds(n)
    assert len(bounds) == min(5, max(2, n // 4))
    for f, (start, end) in enumerate(bounds):
        rows = sorted((int(r["salida"]), r["is_train"]) for r in out if r["fold"] == f)
        assert rows == [(i, i < start) for i in range(end)]
    assert bounds[-1][1] == n


def test_scores(spark):
    rows = [("a", "m", 0, 0, y, p) for y, p in ((10.0, 12.0), (0.0, 5.0), (1.0, 9.0))]
    rows += [("a", "m", 0, 1, 5.0, 5.0), ("a", "m", 0, 1, 5.0, 5.0), ("a", "m", 0, 2, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "sku string, algorithm string, candidate int, fold int, y double, yhat double")
    out = {r["fold"]: r for r in models.score_folds(df).collect()}
    y, p = np.array([10.0, 0.0, 1.0]), np.array([12.0, 5.0, 9.0])
    assert out[0]["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert out[0]["mae"] == pytest.approx(5.0) and out[0]["mape"] == pytest.approx((20 + 200) / 2)
    assert out[1]["r2"] == 1.0 and out[2]["r2"] == 0.0 and out[2]["mape"] == 0.0


def test_winner_and_ties(spark):
    rows = [("a", "Ridge", 0, 0.5), ("a", "Ridge", 1, 0.5), ("a", "Other", 3, 0.5), ("b", "Ridge", 0, 0.1), ("b", "Other", 2, 0.7)]
    df = spark.createDataFrame(rows, "sku string, algorithm string, candidate int, r2 double")
    df = df.withColumns({m: F.lit(1.0) for m in ("mae", "rmse", "mape")})
    best = models.best_candidates(df)
    won = {r["sku"]: (r["algorithm"], r["candidate"]) for r in models.select_winner(best).collect()}
    assert won == {"a": ("Ridge", 0), "b": ("Other", 2)}
    tally = models.winner_tally(models.select_winner(best)).where("most_frequent").collect()
    assert [r["algorithm"] for r in tally] == ["Ridge"]


def test_usable_features(spark):
    df = spark.createDataFrame([("a", 1.0, "x"), ("a", None, "y"), ("b", 1.0, "1")], "sku string, n double, t string")
    rows = models.usable_features(df, ["n", "t"]).collect()
    assert {(r["sku"], r["feature"], r["error"]) for r in rows} == {("a", "n", None), ("b", None, "No numeric cols")}


def plain_recursion(weights, intercept, columns, latest, demand, ahead, horizon):
    """The recursion week by week: rows start as the last one, then calendar, lags and averages are set anew."""
    series, out = list(demand), []
    for h in range(1, horizon + 1):
        row = dict(zip(columns, latest)) | ahead(h)
        for c in columns:
            if c.startswith("lag_") and len(series) >= int(c[4:]):
                row[c] = series[-int(c[4:])]
            if c.startswith("ma_"):
                row[c] = float(np.mean(series[-int(c[3:]):]))
        series.append(max(0.0, intercept + sum(w * row[c] for w, c in zip(weights, columns))))
        out.append(series[-1])
    return out


@pytest.mark.parametrize("n", [1, 3, 60])
def test_recursion_feeds_predictions_back(spark, n):
    rng = np.random.default_rng(n)
    columns = ["lag_1", "ma_2", "mes", "lag_4", "lag_52", "ma_26", "semana_sin", "trim_1", "yoy_ratio"]
    demand, latest, weights = rng.gamma(2, 10, n), rng.normal(size=9), rng.normal(size=9) / 4
    last = dt.date(2023, 11, 6)
    row = ("a", last, 4.0, weights.tolist(), latest.tolist(), 3.0, demand[-52:].tolist())
    fitted = spark.createDataFrame([row], FITTED)

    def ahead(h):
        day = last + dt.timedelta(weeks=h)
        return {"mes": day.month, "semana_sin": math.sin(2 * math.pi * day.isocalendar()[1] / 52), "trim_1": float(day.month <= 3)}

    out = sorted(forecast.unroll(fitted, columns, 60).collect(), key=lambda r: r["h"])
    np.testing.assert_allclose([r["raw"] for r in out], plain_recursion(weights, 7.0, columns, latest, demand, ahead, 60), rtol=1e-9)
    assert [r["week_start"] for r in out] == [last + dt.timedelta(weeks=h) for h in range(1, 61)]


def test_the_recursion_stays_in_the_jvm(spark):
    fitted = spark.createDataFrame([("a", dt.date(2023, 1, 2), 1.0, [0.5], [1.0], 0.0, [4.0])], FITTED)
    plan = forecast.unroll(fitted, ["lag_1"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_seasonal_index_is_clipped_and_empty_without_demand(series):
    out = forecast.seasonal_index(series({"a": [1.0, 100.0, 0.0] + [1.0] * 30, "zero": [0.0, 0.0]})).collect()
    assert {r["sku"] for r in out} == {"a"}
    factors = {r["iso_week"]: r["factor"] for r in out}
    assert factors[2] == 4.0 and factors[3] == 0.2


def test_interval(spark):
    df = spark.createDataFrame([("a", 4, dt.date(2023, 1, 2), 10.0, 3.0)], "sku string, h int, week_start date, prediction double, sigma double")
    row = forecast.forecast_interval(df).first()
    assert (row["lower"], row["upper"]) == (0.0, round(10 + 1.96 * 6, 2))


def test_search_and_forecast_end_to_end(series):
    rng = np.random.default_rng(5)
    x = 50 + 20 * np.sin(np.arange(130) / 52 * 2 * np.pi) + rng.normal(0, 2, 130)
    table = features.build_features(dense_of(series({"a": x, "b": x * 2}))).persist()
    columns = features.feature_columns(table, leak_safe=True)
    best, winners = models.search(table, columns, SMALL)
    assert best.count() == 2 and winners.count() == 2
    fitted = forecast.fit_final(table, winners, columns).persist()
    out = forecast.recursive_forecast(table, winners, fitted, columns, 52).collect()
    assert len(out) == 104
    assert all(0 <= r["lower"] <= r["prediction"] <= r["upper"] for r in out)
    assert min(r["week_start"] for r in out) == dt.date(2022, 1, 3) + dt.timedelta(weeks=130)
    stats = forecast.residual_stats(fitted).collect()
    assert all(len(r["residuals"]) == 104 for r in stats)
    assert forecast.forecast_metadata(winners, fitted).count() == 2


def test_ridge_predictions_equal_a_plain_loop(series):
    rng = np.random.default_rng(6)
    table = features.build_features(dense_of(series({"a": rng.gamma(2, 10, 40)}))).persist()
    columns = ["lag_1", "ma_4", "semana_sin"]
    out = models.cross_validate(table, columns, {"Ridge": {"alpha": [10.0]}}).collect()
    pdf = table.toPandas().sort_values("week_start")
    x, y = pdf[columns].to_numpy(), pdf["salida"].to_numpy()
    for f, (start, end) in enumerate(models.fold_bounds(40)):
        expected = Ridge(10.0).fit(x[:start], y[:start]).predict(x[start:end])
        mine = [r["yhat"] for r in sorted((r for r in out if r["fold"] == f), key=lambda r: r["week_start"])]
        np.testing.assert_allclose(mine, expected)


def test_all_penalties_of_the_grid_equal_separate_fits(series):
    """Running moments and one factorisation a fold, against a linear system for every fold and penalty."""
    rng = np.random.default_rng(7)
    table = features.build_features(dense_of(series({"a": rng.gamma(2, 1000, 90), "b": rng.gamma(2, 10, 30), "c": [5.0] * 40, "d": [1.0, 2.0]}))).persist()
    columns = features.feature_columns(table, leak_safe=True)
    out = models.cross_validate(table, columns).toPandas()
    assert set(out["sku"]) == {"a", "b", "c"} and set(out["candidate"]) == {0, 1, 2}
    for sku, n in (("a", 90), ("b", 30), ("c", 40)):
        pdf = table.where(F.col("sku") == sku).toPandas().sort_values("week_start")
        x, y = pdf[columns].to_numpy(dtype=float), pdf["salida"].to_numpy()
        for f, (start, end) in enumerate(models.fold_bounds(n)):
            xc = x[:start] - x[:start].mean(0)
            for k, alpha in enumerate(models.RIDGE_GRID["alpha"]):
                w = np.linalg.solve(xc.T @ xc + alpha * np.eye(len(columns)), xc.T @ (y[:start] - y[:start].mean()))
                mine = out[(out["sku"] == sku) & (out["fold"] == f) & (out["candidate"] == k)].sort_values("week_start")["yhat"]
                np.testing.assert_allclose(mine, (x[start:end] - x[:start].mean(0)) @ w + y[:start].mean(), rtol=1e-6, atol=1e-6)


def test_columns_that_are_no_numbers_are_not_fitted(series):
    table = series({"a": range(1, 30), "b": range(30)}).withColumns({"x": F.col("salida") * 2, "text": F.when(F.col("sku") == "a", "abc").otherwise("3")})
    only_text = models.cross_validate(table, ["text"], {"Ridge": {"alpha": [1.0]}}).collect()
    assert {r["sku"] for r in only_text} == {"b"}
    both = models.cross_validate(table, ["x", "text"], {"Ridge": {"alpha": [1.0]}})
    alone = models.cross_validate(table, ["x"], {"Ridge": {"alpha": [1.0]}})
    key = lambda r: (r["sku"], r["fold"], r["week_start"])
    assert [r["yhat"] for r in sorted(both.collect(), key=key)] == pytest.approx([r["yhat"] for r in sorted(alone.collect(), key=key)])


def test_one_training_week_has_the_scores_width(series):
    df = series({"a": [4.0]}).withColumn("x", F.lit(1.0))
    winners = df.selectExpr("sku", "'Ridge' AS algorithm", "map('alpha', 1.0D) AS params", "3.5D AS mae", "0.0D AS rmse")
    row = forecast.fit_final(df, winners, ["x"]).first()
    assert (row["resid_std"], row["sales_std"], row["intercept"]) == (None, 3.5, 4.0)
    assert forecast.fit_final(df, winners.drop("mae"), ["x"]).first()["sales_std"] == 50.0


def with_categories(df, clients=1500):
    """Weeks with a client each, over all SKUs as many as asked, and a channel."""
    return df.withColumns({"cliente_modo": F.concat(F.lit("c"), (F.abs(F.hash("sku", "week_start")) % clients).cast("string")),
                           "canal_modo": F.when(F.month("week_start") > 6, "Tienda").otherwise("Web")})


def indicator_matrix(pdf):
    return np.column_stack([(pdf[c] == v).to_numpy(float) for c in ("cliente_modo", "canal_modo") for v in sorted(pdf[c].dropna().unique())])


def test_categories_reach_the_models(series, spark):
    """1,500 clients over all SKUs: each SKU's own become its indicators, in the search, the final fit and the forecast."""
    rng = np.random.default_rng(8)
    table = with_categories(series({f"p{i}": rng.gamma(2, 10, 60) + (np.arange(60) % 52 > 26) * 50 for i in range(60)}).withColumn("x", F.col("salida") * 0 + F.rand(1))).persist()
    assert table.select("cliente_modo").distinct().count() > 1300
    names = ("cliente_modo", "canal_modo")
    out = models.cross_validate(table, ["x"], {"Ridge": {"alpha": [2.0]}}, names).toPandas()
    _, winners = models.search(table, ["x"], {"Ridge": {"alpha": [2.0]}}, lambda df: df, names)
    fitted = {r["sku"]: r for r in forecast.fit_final(table, winners, ["x"], categories=names).collect()}
    assert len(fitted) == 60
    for sku in ("p0", "p17", "p59"):
        pdf = table.where(F.col("sku") == sku).toPandas().sort_values("week_start")
        x, y = np.column_stack([pdf["x"], indicator_matrix(pdf)]), pdf["salida"].to_numpy()
        for f, (start, end) in enumerate(models.fold_bounds(60)):
            mine = out[(out["sku"] == sku) & (out["fold"] == f)].sort_values("week_start")["yhat"]
            np.testing.assert_allclose(mine, Ridge(2.0).fit(x[:start], y[:start]).predict(x[start:end]), rtol=1e-8)
        model, row = Ridge(2.0).fit(x, y), fitted[sku]
        np.testing.assert_allclose(row["intercept"] + row["weights"][0] * row["latest"][0] + row["standing"], model.predict(x[-1:])[0])
        np.testing.assert_allclose(row["residuals"], y - model.predict(x), atol=1e-8)
