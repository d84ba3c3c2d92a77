"""What the physical plans must not contain, and results under a hot key."""

import numpy as np
import pytest

from demand_engine.operators import cleaning, materials, outliers, weekly
from demand_engine.plans import catalog, ledger_views


def plan(df):
    """The whole physical plan (sessions of this package print only its start)."""
    spark = df.sparkSession
    short = spark.conf.get("spark.sql.maxPlanStringLength")
    spark.conf.set("spark.sql.maxPlanStringLength", str(2**31 - 16))
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.maxPlanStringLength", short)


@pytest.mark.parametrize("name", ["f4_weekly_by_sku", "c1_cap_p99", "e1_pareto_curve", "g_all_features", "y5_production_plan"])
def test_no_cross_join(spark, name):
    text = plan(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_reads_only_what_is_needed(spark):
    text = plan(catalog.QUERIES["f1_weekly_totals"](spark, "/root/testdata/sf0.001"))
    scans = [line for line in text.splitlines() if "lineitem" in line]
    assert scans and all("l_extendedprice" not in s and "l_tax" not in s for s in scans)


def test_feature_windows_share_one_exchange(spark):
    df = spark.createDataFrame([("a", "2022-01-03", 1.0, 1)], "sku string, week_start string, salida double, transacciones long")
    df = df.withColumn("week_start", df["week_start"].cast("date")).withColumns(
        {c: df["salida"] for c in ("salida_promedio", "salida_std", "salida_min", "salida_max")})
    from demand_engine.operators import features

    assert plan(features.build_features(df)).count("Exchange hashpartitioning") == 1


def test_hot_product_gives_the_same_results(spark):
    """One product holds most rows, all quantities different: nothing is dropped or capped wrongly."""
    rng = np.random.default_rng(9)
    hot, cold = rng.lognormal(3, 2, 20000), rng.lognormal(3, 1, 300)
    rows = [("hot", float(v)) for v in hot] + [(f"c{i % 30}", float(v)) for i, v in enumerate(cold)]
    df = spark.createDataFrame(rows, "sku string, salida double").selectExpr(
        "sku", "salida", "0D AS entrada", "date'2023-01-02' AS fecha", "'1' AS numero", "'Venta' AS documento", "0D AS saldo")
    capped = outliers.cap_p99(df, ("salida",))
    top = np.quantile(hot, 0.99)
    assert capped.count() == len(rows)
    assert capped.where("sku = 'hot' and salida_capped").count() == int((hot > top).sum())
    assert weekly.weekly_by_sku(cleaning.sales(df)).where("sku = 'hot'").first()["sales"] == pytest.approx(hot.sum())


def test_running_stock_joins_nothing_and_costs_nothing_unless_asked_for(spark):
    rows = [("a", "2023-01-02", 2, 1.0, 0.0), ("a", "2023-01-02", 1, 5.0, 0.0), ("a", "2023-01-04", 3, 0.0, 2.0), ("b", "2023-01-03", 4, None, 1.0),
            ("b", "2023-01-05", 5, 7.0, 0.0), ("a", None, 6, 9.0, 0.0), (None, "2023-01-01", 7, 9.0, 0.0)]
    df = spark.createDataFrame(rows, "sku string, fecha string, orden long, entrada double, salida double").selectExpr(
        "sku", "cast(fecha AS date) AS fecha", "orden", "1 AS linea", "1L AS parte", "1L AS proveedor", "1D AS importe", "entrada", "salida")
    out = ledger_views.with_balance(df, df)
    assert out.columns == [*df.columns, "saldo"]
    text = plan(out)
    assert "Join" not in text and text.count("- Window ") == 2
    assert {r["orden"]: r["saldo"] for r in out.collect()} == {1: 14.0, 2: 15.0, 3: 13.0, 4: None, 5: 7.0}
    totals = plan(out.groupBy("sku").sum("salida"))
    assert "Join" not in totals and "Window" not in totals and totals.count("- Exchange") == 1


@pytest.mark.parametrize("name", ["y17_overproduction_cost", "y17_overproduction_impact", "y17_extra_costs", "y18_policy_savings", "y18_policy_totals"])
def test_items_are_summed_up_in_all_shuffle_partitions(spark, name):
    """Sums by day would hold every movement of a sparse item; AQE would merge their partitions into tasks that grow with the ledger."""
    text = plan(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))
    exchanges = [line for line in text.splitlines() if "Exchange hashpartitioning(" in line]
    assert not any("fecha" in line.split("),")[0] for line in exchanges)
    assert any("week_start" in line.split("),")[0] and "REPARTITION_BY_NUM" in line for line in exchanges)
    assert all("Exchange hashpartitioning(tipo" not in line for line in exchanges)


def test_prices_go_to_the_yields_not_the_other_way_round(spark):
    prices, yields = materials.sheet_config(spark)
    text = plan(materials.unit_cost(prices, yields))
    assert "BroadcastHashJoin" in text and "BuildRight" in text
