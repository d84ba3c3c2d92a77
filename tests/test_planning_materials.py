import datetime as dt

import numpy as np
import pytest

from demand_engine.operators import materials, planning, rollups, weekly


def forecast_frame(spark, values):
    rows = [(sku, h, dt.date(2023, 1, 2) + dt.timedelta(weeks=h), float(v), float(v) * 0.8, float(v) * 1.2)
            for sku, vs in values.items() for h, v in enumerate(vs, 1)]
    return spark.createDataFrame(rows, "sku string, h int, week_start date, prediction double, lower double, upper double")


def weekly_frame(spark, sales, stock):
    rows = [(sku, dt.date(2022, 1, 3) + dt.timedelta(weeks=i), float(v), float(v) + 1, float(stock[sku]))
            for sku, vs in sales.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "sku string, week_start date, sales double, production double, closing_stock double")


def loop_plan(demand, stock, weeks):
    """The weekly refill rule, step by step."""
    safety, rows = weeks * np.mean(demand), []
    for d in demand:
        rest = stock - d
        made = max(0.0, d + safety - stock) if rest < safety else 0.0
        rows.append((made, stock, stock + made - d, rest < 0))
        stock = stock + made - d
    return rows


@pytest.mark.parametrize("weeks", [0.5, 2, 12])
def test_plan_equals_the_weekly_loop(spark, weeks):
    rng = np.random.default_rng(int(weeks * 10))
    values = {f"s{i:02d}": rng.gamma(1, 30, 52).round(2) * rng.integers(0, 2, 52) for i in range(20)}
    stock = {s: float(rng.integers(-50, 2000)) for s in values}
    sales = {s: [1000.0] * 5 for s in values}  # keeps the cap out of the way
    plan = planning.production_plan(forecast_frame(spark, values), weekly_frame(spark, sales, stock), weeks).collect()
    for sku, demand in values.items():
        mine = sorted((r for r in plan if r["sku"] == sku), key=lambda r: r["h"])
        for r, (made, begin, end, urgent) in zip(mine, loop_plan(demand, stock[sku], weeks), strict=True):
            assert abs(r["production"] - made) <= 0.5 + 1e-6 and abs(r["stock_start"] - begin) <= 0.5 + 1e-6
            assert abs(r["stock_end"] - end) <= 0.5 + 1e-6 and r["urgent"] == urgent


def test_cap_uses_the_upper_median(spark):
    caps = planning.sales_cap(weekly_frame(spark, {"even": [1, 2, 30, 40], "odd": [0, 0, 1]}, {"even": 0, "odd": 0})).collect()
    assert {r["sku"]: (r["median"], r["cap"]) for r in caps} == {"even": (30.0, 150.0), "odd": (0.0, 100.0)}


def test_safety_weeks_are_clamped():
    given = {None: 2.0, 0: 2.0, "x": 2.0, 0.1: 0.5, 99: 12.0, "3.5": 3.5, -4: 0.5}
    assert {k: planning.clamp_safety_weeks(k) for k in given} == given


def test_lookup_and_scenarios(spark):
    f = forecast_frame(spark, {"CP_01": [10, 20, 30, 40, 50]})
    points = planning.forecast_lookup(f, ["cp_01 "], 4)
    assert points.count() == 4
    rows = {r["level"]: (r["quantity"], r["confidence"]) for r in planning.production_scenarios(points).collect()}
    assert rows == {"normal": (40.0, 0.9), "optimistic": (44.0, 0.6), "pessimistic": (36.0, 0.95)}
    assert "lower" not in planning.forecast_lookup(f, ["CP_01"], 4, include_confidence=False).columns
    with pytest.raises(ValueError):
        planning.forecast_lookup(f, ["CP_01"], 0)


def test_plan_kpis_without_production(spark):
    plan = planning.production_plan(forecast_frame(spark, {"a": [1, 1]}), weekly_frame(spark, {"a": [5]}, {"a": 1000}))
    row = planning.plan_kpis(plan).first()
    assert (row["units"], row["weeks"], row["urgent"], row["first"]) == (0.0, 0, False, -1)
    assert planning.production_weeks(plan).count() == 0


def test_config_needs_both_maps(spark):
    prices, yields = materials.sheet_config(spark)
    assert prices.count() == 2 and yields.count() == 7
    with pytest.raises(ValueError):
        materials.sheet_config(spark, {"precios": {"a": 1}})


# A few public weekly rows: week, sales, production, closing stock, sheet gap at 0.007 sheets per unit.
KNOWN = [("2020-12-28", 631.0, 38602.0, 37971.0, 265.797), ("2021-01-04", 0.0, 610.0, 38581.0, 4.27),
         ("2021-01-11", 1000.0, 0.0, 37581.0, -7.0), ("2021-01-18", 4660.0, 0.0, 34934.0, -32.62)]


def test_known_sheet_gaps(spark):
    df = spark.createDataFrame([("CERE002", *r[:4]) for r in KNOWN], "sku string, week_start string, sales double, production double, closing_stock double")
    df = df.withColumn("week_start", df["week_start"].cast("date"))
    config = materials.sheets_per_unit(spark)
    gaps = {str(r["week_start"]): r["sheets_gap"] for r in materials.sheet_gap(materials.sheet_consumption(df, config)).collect()}
    assert gaps == {r[0]: pytest.approx(r[4]) for r in KNOWN}
    summary = materials.sheet_cost_summary(df, config).first()
    assert (summary["produccion_total"], summary["ventas_total"], summary["planchas_gap"]) == (39212, 6291, 230.45)
    assert summary["eficiencia"] == 16.0


def test_known_totals(spark):
    """Published totals of one product: efficiency and sheet gap follow from them."""
    df = weekly_frame(spark, {"CER001": [803789]}, {"CER001": 12449}).withColumn("production", weekly.F.lit(816238.0))
    row = materials.sheet_cost_summary(df, materials.sheets_per_unit(spark)).first()
    assert (row["eficiencia"], row["planchas_gap"]) == (98.5, 87.14)
    assert rollups.product_summary(df).first()["eficiencia"] == 98.5


def test_overproduction_impact(spark):
    df = spark.createDataFrame([("CER001", 1141, 1000, 87.6), ("CER005", 10, 20, 100.0)], "sku string, produccion_total long, ventas_total long, eficiencia double")
    costs = materials.unit_cost(*materials.sheet_config(spark))
    over = materials.overproduction_cost(df, costs)
    row = materials.overproduction_impact(over, materials.extra_rates(spark)).first()
    assert row["sobreproduccion"] == 141 and row["costo_material"] == pytest.approx(129.95)
    assert row["impacto_total"] == pytest.approx(129.95 * 1.52) and row["multiplicador"] == pytest.approx(1.52)
    assert row["sobreproduccion_pct"] == pytest.approx(141 / 1151 * 100) and row["eficiencia_media"] == pytest.approx(93.8)


def test_seasonality_has_all_months(spark):
    df = weekly_frame(spark, {"a": [10, 20, 30, 40, 50]}, {"a": 0})
    monthly = rollups.monthly_mean_demand(df)
    assert monthly.count() == 12
    index = {r["mes"]: r["indice"] for r in rollups.seasonality_index(monthly).collect()}
    assert index[1] == 1200.0 and index[2] == 0.0
