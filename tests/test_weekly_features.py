import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from demand_engine.operators import demand_class, features, weekly


def dense_of(df):
    """The minimum that features need, on a gap-free series."""
    return df.select(
        "sku", "week_start", F.extract(F.lit("YEAROFWEEK"), "week_start").alias("iso_year"),
        F.weekofyear("week_start").alias("iso_week"), "salida", F.lit(2).cast("long").alias("transacciones"),
        F.lit(1.0).alias("salida_promedio"), F.lit(0.5).alias("salida_std"), F.lit(1.0).alias("salida_min"),
        F.lit(2.0).alias("salida_max"), F.lit("c").alias("cliente_modo"), F.lit("k").alias("canal_modo"),
        F.lit("p").alias("punto_modo"), F.lit(False).alias("is_imputed"),
    )


def test_iso_week_53_and_monday(ledger):
    df = ledger({"fecha": "2021-01-01", "salida": 1.0}, {"fecha": "2020-12-28", "salida": 2.0}, {"fecha": None, "salida": 9.0})
    row = weekly.weekly_demand(df).collect()
    assert len(row) == 1
    assert (row[0]["iso_year"], row[0]["iso_week"], row[0]["week_start"]) == (2020, 53, dt.date(2020, 12, 28))


def test_closing_stock_counts_only_moving_products_unless_carried(ledger):
    df = ledger(
        {"sku": "a", "fecha": "2023-01-02", "saldo": 10.0}, {"sku": "b", "fecha": "2023-01-03", "saldo": 5.0},
        {"sku": "a", "fecha": "2023-01-10", "saldo": 7.0},
    )
    plain = {str(r["week_start"]): r["closing_stock"] for r in weekly.weekly_closing_stock(df).collect()}
    carried = {str(r["week_start"]): r["closing_stock"] for r in weekly.weekly_closing_stock(df, carry_forward=True).collect()}
    assert plain == {"2023-01-02": 15.0, "2023-01-09": 7.0}
    assert carried == {"2023-01-02": 15.0, "2023-01-09": 12.0}


def test_weekly_sums_equal_the_ledger(ledger):
    rng = np.random.default_rng(1)
    days = pd.date_range("2022-01-01", periods=200).strftime("%Y-%m-%d")
    df = ledger(*[{"sku": f"s{rng.integers(3)}", "fecha": d, "salida": float(rng.integers(9))} for d in days])
    total = df.agg(F.sum("salida")).first()[0]
    assert weekly.weekly_totals(df).agg(F.sum("sales")).first()[0] == total
    assert weekly.weekly_by_sku(df).agg(F.sum("sales")).first()[0] == total


def test_sparse_weeks_equal_those_by_days(ledger):
    rng = np.random.default_rng(2)
    days = [None, *pd.date_range("2022-12-20", periods=30).strftime("%Y-%m-%d")]
    df = ledger(*[{"sku": rng.choice(["hot", "hot", "a", "b", None]), "fecha": days[rng.integers(len(days))], "numero": str(1000 + i),
                   "entrada": float(rng.integers(5)), "salida": None if i % 17 == 0 else float(rng.integers(9)),
                   "saldo": None if i % 5 == 0 else float(i)} for i in range(300)])
    one = sorted(weekly.weekly_by_sku(df).collect())
    assert one and sorted(weekly.weekly_by_sku(df, sparse=True).collect()) == one
    with pytest.raises(ValueError):
        weekly.weekly_by_sku(df, ("numero",), sparse=True)


def test_densify_and_interpolate_like_pandas(ledger):
    week = dt.date(2022, 1, 3)
    known = {0: 10.0, 1: 4.0, 3: 8.0, 9: 2.0}
    df = ledger(*[{"fecha": str(week + dt.timedelta(weeks=i)), "salida": v, "canal": f"c{i}"} for i, v in known.items()],
                {"sku": "single", "salida": 1.0})
    out = weekly.weekly_dense(weekly.weekly_demand(df)).orderBy("week_start").collect()
    expected = pd.Series([known.get(i) for i in range(10)]).interpolate()
    assert [r["sku"] for r in out] == ["P1"] * 10
    assert np.allclose([r["salida"] for r in out], expected, atol=0)
    assert [r["is_imputed"] for r in out] == [i not in known for i in range(10)]
    assert [r["canal_modo"] for r in out] == ["c0", "c1", "c1", "c3", "c3", "c3", "c3", "c3", "c3", "c9"]
    assert all(b["week_start"] - a["week_start"] == dt.timedelta(days=7) for a, b in zip(out, out[1:]))
    assert out[2]["transacciones"] == 0 and out[0]["salida_std"] == 0.0


def pandas_features(x):
    s = pd.Series(x)
    prev = s.shift(1)
    out = pd.DataFrame({f"lag_{n}": s.shift(n) for n in features.LAGS})
    for w in features.AVERAGES:
        out[f"ma_{w}"] = prev.rolling(w, min_periods=1).mean()
    for w in features.VOLATILITIES:
        out[f"volatilidad_{w}"] = prev.rolling(w, min_periods=1).std().fillna(0)
    for n in features.SPANS:
        out[f"ewma_{n}"] = prev.ewm(span=n, adjust=False).mean()
    filled = out.ffill().bfill().fillna(0)
    filled["yoy_ratio"] = (prev / s.shift(52).replace(0, np.nan)).fillna(1.0).clip(0, 5)
    up = (s > 0).astype(int)
    filled["semanas_desde_ultima_venta"] = up.groupby((up != up.shift()).cumsum()).cumcount()
    filled["semana_consecutivas_venta"] = up.cumsum()
    filled["anomalia_binaria"] = ((s > 0) & (out["ma_4"] > 0) & (s < 0.7 * out["ma_4"])).astype(int)
    trend = (s - out["ma_8"]) / out["ma_8"]
    filled["trend_vs_ma8"] = trend.replace([np.inf, -np.inf], np.nan).fillna(0)
    return filled


@pytest.mark.parametrize("length", [2, 60, 600])
def test_features_equal_pandas(series, length):
    rng = np.random.default_rng(length)
    x = np.where(rng.random(length) < 0.3, 0, rng.gamma(2, 50, length)).round(2)
    out = features.build_features(dense_of(series({"a": x, "b": x[::-1]}))).where("sku = 'a'").toPandas().sort_values("week_start")
    expected = pandas_features(x)
    for c in expected.columns:
        np.testing.assert_allclose(out[c].to_numpy(dtype=float), expected[c].to_numpy(dtype=float), rtol=1e-9, atol=1e-7, err_msg=c)


def test_leak_safe_features_never_see_the_current_week(series):
    x = np.arange(1.0, 41.0)
    y = x.copy()
    y[30:] = 999.0
    a = features.build_features(dense_of(series({"s": x})), backfill=False)
    b = features.build_features(dense_of(series({"s": y})), backfill=False)
    safe = features.feature_columns(a, leak_safe=True)
    cut = dt.date(2022, 1, 3) + dt.timedelta(weeks=30)
    left = a.where(F.col("week_start") <= F.lit(cut)).select(safe).toPandas()
    right = b.where(F.col("week_start") <= F.lit(cut)).select(safe).toPandas()
    pd.testing.assert_frame_equal(left, right)


def test_one_hot_is_null_for_categories_a_product_never_has(spark, series):
    df = dense_of(series({"a": [1, 2], "b": [3, 4]})).withColumn("canal_modo", F.when(F.col("sku") == "a", "x").otherwise("y"))
    assert features.categories(df, "canal_modo") == ["x", "y"]
    wide = {r["sku"]: (r["canal_x"], r["canal_y"]) for r in features.one_hot(df, {"canal_modo": ["x", "y"]}).collect()}
    assert wide == {"a": (1, None), "b": (None, 1)}
    assert features.one_hot_long(features.calendar_features(df)).count() == 4 * 4


@pytest.mark.parametrize(
    "values,kind",
    [
        ([1.0, 1.0, 500.0, 1.0], "ERRATIC"),
        ([5.0, 5.0, 5.0], "HYBRID_ERRATIC"),
        ([5.0, 0.0, 0.0, 6.0], "INTERMITTENT"),
        ([1.0, 0.0, 0.0, 500.0, 1.0], "HYBRID_INTERMITTENT"),
        ([0.0, 0.0], "HYBRID_INTERMITTENT"),
        ([4.0], "HYBRID_ERRATIC"),
        ([1.0, 2.0] * 12 + [1.0] + [0.0] * 8, "HYBRID_INTERMITTENT"),  # 33 weeks / 25 = 1.32 exactly
    ],
)
def test_demand_classes(series, values, kind):
    row = demand_class.classify_demand(demand_class.adi_cv2(series({"a": values}))).first()
    assert row["cluster"] == kind
    assert row["grupo"] == (demand_class.GROUP_1 if kind.endswith("ERRATIC") else demand_class.GROUP_2)
    if not any(values):
        assert row["adi"] == float("inf") and row["cv2"] is None


def test_ewma_of_any_span_equals_the_plain_recursion(series):
    rng = np.random.default_rng(1)
    values = rng.gamma(2, 10, 800)
    spans = (1, 4, 52, 200)
    df = features.ewma(features.linear_trend(features.lags(series({"a": values}))), spans)
    rows = sorted(df.collect(), key=lambda r: r["week_start"])
    for span in spans:
        a, state = 2 / (span + 1), values[0]
        assert rows[0][f"ewma_{span}"] is None
        for t in range(1, 800):
            state = state if t == 1 else (1 - a) * state + a * values[t - 1]
            assert rows[t][f"ewma_{span}"] == pytest.approx(state, rel=1e-9)


def test_weekly_modes_from_one_shuffle_of_plain_movements(spark, ledger):
    df = ledger({"salida": 1.0, "cliente": "b", "canal": None, "punto": "y"}, {"salida": 2.0, "cliente": "b", "canal": None, "punto": "x"},
                {"salida": 6.0, "cliente": "a", "canal": "k", "punto": None}, {"salida": 7.0, "cliente": "a", "canal": None, "punto": None},
                {"sku": "Q", "salida": 4.0, "cliente": None, "canal": None, "punto": None}, {"sku": None, "salida": 5.0}, {"fecha": None, "salida": 5.0})
    out = weekly.weekly_demand(df)
    text = out._jdf.queryExecution().executedPlan().toString()
    rows = {r["sku"]: r for r in out.collect()}
    assert {k: (r["cliente_modo"], r["canal_modo"], r["punto_modo"]) for k, r in rows.items()} == {"P1": ("a", "k", "x"), "Q": ("Unknown", "Unknown", "Unknown")}
    p = rows["P1"]
    assert (p["salida"], p["transacciones"], p["salida_promedio"], p["salida_min"], p["salida_max"]) == (16.0, 4, 4.0, 1.0, 7.0)
    assert p["salida_std"] == pytest.approx(np.std([1, 2, 6, 7], ddof=1)) and rows["Q"]["salida_std"] is None
    assert text.count("- Exchange") == 1 and "REPARTITION_BY_NUM" in text and "Generate" not in text and "HashAggregate" not in text
