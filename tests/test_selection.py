import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from demand_engine.functions.moments import correlation_p_value
from demand_engine.operators import features, selection


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(42)
    n = 60
    base = rng.gamma(2, 20, n)
    data = {
        "salida": base, "lag_1": np.roll(base, 1), "lag_2": np.roll(base, 2), "ma_2": base + rng.normal(0, 1, n),
        "ma_13": rng.random(n), "volatilidad_4": rng.random(n), "trend_4": rng.normal(0, 1, n),
        "mes": rng.integers(1, 13, n).astype(float), "trimestre": np.full(n, 3.0),
    }
    data["lag_2"][5] = np.nan
    names = list(data)
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in zip(*data.values(), strict=True)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(5)
    return df, data


NAMES = ["lag_1", "lag_2", "ma_2", "ma_13", "volatilidad_4", "trend_4", "mes", "trimestre"]


def test_correlations_equal_numpy_pairwise(frame):
    df, data = frame
    for r in selection.correlation_matrix(df, NAMES).collect():
        a, b = data[r["a"]], data[r["b"]]
        ok = ~np.isnan(a) & ~np.isnan(b)
        if "trimestre" in (r["a"], r["b"]):
            assert r["r"] is None
        else:
            assert r["r"] == pytest.approx(np.corrcoef(a[ok], b[ok])[0, 1], abs=1e-10)
        assert r["n"] == ok.sum()


def test_pairs_are_listed_once(spark):
    m = spark.createDataFrame([("a", "b", 0.97), ("b", "a", 0.97), ("a", "a", 1.0), ("a", "c", -0.96), ("b", "c", 0.5)], "a string, b string, r double")
    assert {(r["a"], r["b"]) for r in selection.high_corr_pairs(m, 0.95).collect()} == {("a", "b"), ("a", "c")}


def test_vif_equals_regression_without_intercept(frame):
    df, data = frame
    out = {r["feature"]: r["vif"] for r in selection.vif(df, NAMES).collect()}
    complete = [c for c in NAMES if c != "lag_2"]  # has an unknown value
    assert set(out) == set(complete)
    x = np.column_stack([data[c] for c in complete])
    for i, c in enumerate(complete):
        others = np.delete(x, i, axis=1)
        fit = others @ np.linalg.lstsq(others, x[:, i], rcond=None)[0]
        r2 = 1 - ((x[:, i] - fit) ** 2).sum() / (x[:, i] ** 2).sum()
        assert out[c] == pytest.approx(1 / (1 - r2), rel=1e-6)


def test_vif_of_dependent_columns_is_infinite(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a), float(1 - a), 1.0, float(z)) for a, z in zip(rng.integers(0, 2, 50), rng.random(50), strict=True)]
    df = spark.createDataFrame(rows, "a double, b double, c double, z double")
    out = {r["feature"]: r["vif"] for r in selection.vif(df, ["a", "b", "c", "z"]).collect()}
    assert out["a"] == out["b"] == out["c"] == math.inf and out["z"] < 10


def test_target_correlation_and_p_value(frame):
    df, data = frame
    out = {r["feature"]: r for r in selection.target_correlation(df, NAMES).collect()}
    assert (out["trimestre"]["correlacion"], out["trimestre"]["pvalor"]) == (0.0, 1.0)
    r = out["trend_4"]["correlacion"]
    t = abs(r) * math.sqrt(58 / (1 - r * r))
    grid = np.linspace(t, 400, 2_000_001)  # numeric integral of the t density
    density = (1 + grid**2 / 58) ** (-59 / 2) * math.exp(math.lgamma(29.5) - math.lgamma(29)) / math.sqrt(58 * math.pi)
    assert out["trend_4"]["pvalor"] == pytest.approx(2 * np.trapezoid(density, grid), rel=1e-4)


def tail_of_t(r, n):
    """What of Student's t lies beyond, as the rest of a series of positive terms: good for tiny values, too."""
    v, s, c2 = n - 2, abs(r), 1 - r * r
    if v % 2 == 0:
        first, terms = v // 2, lambda j: math.lgamma(j + 0.5) - math.lgamma(j + 1) - 0.5 * math.log(math.pi) + j * math.log(c2)
    else:
        first, terms = (v - 1) // 2, lambda j: 0.5 * math.log(math.pi) - math.log(2) + math.lgamma(j + 1) - math.lgamma(j + 1.5) + (j + 0.5) * math.log(c2)
        s *= 2 / math.pi
    total, j = 0.0, first
    while (term := math.exp(terms(j))) > 1e-18 * total and term > 0:
        total, j = total + term, j + 1
    return s * total


def test_p_values(spark):
    cases = [(r, n) for n in (3, 4, 5, 6, 30, 61, 1000, 9001) for r in (0.05, -0.2, 0.5, -0.9, 0.999)]
    df = spark.createDataFrame(cases, "r double, n long").select("r", "n", correlation_p_value("r", "n").alias("p"))
    for row in df.collect():
        if (want := tail_of_t(row["r"], row["n"])) > 1e-290:
            assert row["p"] == pytest.approx(want, rel=1e-8), (row["r"], row["n"])
    odd = spark.createDataFrame([(None, 9), (0.0, 9), (1.0, 9), (-1.0, 9), (0.4, 2), (0.4, 1), (1e-5, 10**9), (0.01, 10**9)], "r double, n long")
    got = [row["p"] for row in odd.select(correlation_p_value("r", "n").alias("p")).collect()]
    assert got[:6] == [1.0, 1.0, 0.0, 0.0, 1.0, 1.0]
    assert got[6] == pytest.approx(math.erfc(1e-5 * math.sqrt(5e8)), rel=1e-6) and got[7] == 0.0  # the normal distribution
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_feature_sets():
    names = ["lag_1", "ma_2", "ma_4", "ewma_4", "volatilidad_4", "canal_x", "mes", "yoy_ratio", "anomalia_binaria"]
    sets = selection.feature_sets(names, ["lag_1"])
    assert sets["conservative"] == ["ma_2", "volatilidad_4"]
    assert sets["intermediate"] == ["ma_2", "volatilidad_4", "canal_x"]
    assert sets["aggressive"] == names[1:]
    roles = selection.feature_roles(names)
    assert "yoy_ratio" not in roles and "anomalia_binaria" not in roles and roles["mes"] == "temporal"


def test_summary_counts(frame):
    df, _ = frame
    table = df.withColumn("sku", F.lit("a"))
    matrix, factors = selection.correlation_matrix(table, NAMES), selection.vif(table, NAMES)
    row = selection.selection_summary(table, matrix, factors).first()
    assert row["total_registros"] == 60 and row["total_features"] == 8 and row["n_pasado"] == 5  # trend_4 is no declared feature
    sets = selection.select_sets(table, factors)
    assert set(sets) == {"conservative", "intermediate", "aggressive"}
    assert all({"sku", "salida"} <= set(s.columns) for s in sets.values())


def test_roles_do_not_depend_on_what_categories_are_called():
    names = ["empresa_Alma_X", "canal_Gama_Alta", "punto_lag_1", "trim_2", "trend_vs_ma4", "ewma_4", "salida_total"]
    roles = selection.feature_roles(names)
    assert roles == {**dict.fromkeys(names[:4], "futuro"), "trend_vs_ma4": "pasado", "ewma_4": "pasado"}
    assert selection.feature_sets(names, [])["intermediate"] == ["trend_vs_ma4", *names[:4]]


def test_sparse_indicators_equal_their_wide_columns(spark):
    """1,500 clients: correlations from the sparse form against numpy on the wide one."""
    rng = np.random.default_rng(11)
    rows = [(f"s{s}", dt.date(2020, 1, 6) + dt.timedelta(weeks=w), float(rng.gamma(2, 10)), f"c{int(rng.integers(1500)) if s < 40 else s}", ["a", "b"][int(rng.integers(2))])
            for s in range(45) for w in range(40)]
    df = spark.createDataFrame(rows, "sku string, week_start date, salida double, cliente_modo string, canal_modo string")
    long = features.one_hot_long(df, {"cliente_modo": "empresa", "canal_modo": "canal"}).persist()
    assert long.select("feature").distinct().count() > 900
    wide = {}
    for c, prefix, k in (("cliente_modo", "empresa", 3), ("canal_modo", "canal", 4)):
        for v in {r[k] for r in rows}:
            skus = {r[0] for r in rows if r[k] == v}
            wide[f"{prefix}_{v}"] = np.array([float(r[k] == v) if r[0] in skus else np.nan for r in rows])
    y = np.array([r[2] for r in rows])
    for r in selection.indicator_target(long, df).collect():
        v = wide[r["feature"]]
        ok = ~np.isnan(v)
        if v[ok].min() == v[ok].max():
            assert (r["correlacion"], r["pvalor"]) == (0.0, 1.0)
        else:
            assert r["correlacion"] == pytest.approx(np.corrcoef(v[ok], y[ok])[0, 1], abs=1e-9)
    some = {f"empresa_c{s}" for s in range(40, 45)} | {"canal_a", "canal_b"} | set(list(wide)[:30])
    pairs = selection.indicator_correlation(long.where(F.col("feature").isin(*some)), df, ["salida"]).where("b <> 'salida'").collect()
    seen = set()
    for r in pairs:
        a, b = wide[r["a"]], wide[r["b"]]
        ok = ~np.isnan(a) & ~np.isnan(b)
        seen.add((r["a"], r["b"]))
        assert r["n"] == ok.sum()
        flat = a[ok].min() == a[ok].max() or b[ok].min() == b[ok].max()
        assert (r["r"] is None) if flat else r["r"] == pytest.approx(np.corrcoef(a[ok], b[ok])[0, 1], abs=1e-9)
    assert seen == {(a, b) for a in some for b in some if a < b and (~np.isnan(wide[a]) & ~np.isnan(wide[b])).any()}
