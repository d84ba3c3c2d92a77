import datetime as dt

import numpy as np
import pytest

from demand_engine.plans import full_run

GRID = {"Ridge": {"alpha": [1.0, 10.0]}}


def test_ledger_to_plan(ledger):
    rng = np.random.default_rng(0)
    start = dt.date(2022, 1, 3)
    rows = []
    for i in range(24):
        day = str(start + dt.timedelta(weeks=i))
        rows.append({"sku": "CER 001", "fecha": day, "salida": float(10 + rng.integers(0, 5)), "saldo": 50.0, "numero": f"{i}"})
        rows.append({"sku": "CER 001", "fecha": day, "entrada": 12.0, "documento": "Ingreso", "saldo": 60.0, "numero": f"i{i}"})
        rows.append({"sku": "X", "fecha": day, "salida": 1.0, "numero": f"x{i}"})
    run = full_run.run_all(ledger(*rows), GRID)
    assert run["weekly"].count() == 24 and run["top_products"].count() == 2
    assert {r["sku"] for r in run["pareto"].where("in_80").collect()} == {"CER 001"}
    assert run["features"].count() == 24 and run["vif"].count() > 10
    assert run["winners"].count() == 1
    assert run["forecast"].count() == 52
    assert run["plan"].count() == 52 and run["plan_header"].first()["stock_actual"] == 60.0
    for name, table in run.tables.items():
        if name in ("outlier_report",):
            continue
        assert table.limit(1).count() == 1, name


def test_oracle_names_match():
    from demand_engine.plans import catalog

    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert len(catalog.QUERIES) > 120


@pytest.mark.parametrize("name", ["f4_weekly_by_sku", "c2_replace_iqr_outliers", "e1_pareto_curve", "y5_production_plan"])
def test_checked_queries_at_the_smallest_scale(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from check_oracles import canonical
    from demand_engine.plans import catalog

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("lineitem", "part", "orders", "customer", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    rel = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in rel.description]
    df = catalog.QUERIES[name](spark, folder)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(rel.fetchall(), names)
