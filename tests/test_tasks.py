import datetime as dt

import pytest

from demand_engine.operators import tasks

T0, T1, T2 = (dt.datetime(2024, 1, d, 8) for d in (1, 2, 3))


def operator(name, given, key=None):
    return (key, key and f"tok-{key}", name, None, given)


@pytest.fixture
def stored(spark):
    rows = [
        ("2024-01-01", dt.date(2024, 1, 1), {"A": 10.0, "B": 0.0}, [operator("ana", {"A": 6.0, "B": 3.0}, "o1"), operator("luz", {"A": 6.0}, "o2")],
         {"o1": ({"A": 3.0}, "", T0)}, T0, T0),
    ]
    return spark.createDataFrame(rows, tasks.ASSIGNMENTS)


def test_upsert_keeps_progress_and_creation(spark, stored):
    new = spark.createDataFrame(
        [("2024-01-01", dt.date(2024, 1, 2), {"A": 20.0}, [operator("ana", {"A": 9.0})], None, None, T1),
         ("2024-01-08", dt.date(2024, 1, 8), None, None, None, None, T1)], tasks.ASSIGNMENTS)
    out = {r["semana"]: r for r in tasks.merge_assignments(stored, new).collect()}
    old = out["2024-01-01"]
    assert old["metas_sku"] == {"A": 20.0} and list(old["progreso"]) == ["o1"]
    assert (old["created_at"], old["updated_at"]) == (T0, T1)
    assert len(old["operarios"][0]["id"]) == 8 and len(old["operarios"][0]["token"]) == 16
    assert out["2024-01-08"]["operarios"] == [] and out["2024-01-08"]["created_at"] == T1


def test_weeks_without_update_stay(spark, stored):
    none = spark.createDataFrame([], tasks.ASSIGNMENTS)
    assert tasks.merge_assignments(stored, none).first().asDict(True) == stored.first().asDict(True)


def test_latest_progress_wins_and_unknown_weeks_are_rejected(spark, stored):
    updates = spark.createDataFrame(
        [("2024-01-01", "o1", {"A": 5.0}, "x", T1), ("2024-01-01", "o1", {"A": 9.0}, None, T2), ("2030-01-01", "o1", {}, "", T1)], tasks.UPDATES)
    merged, rejected = tasks.merge_progress(stored, updates)
    row = merged.first()
    assert row["progreso"]["o1"]["avances"] == {"A": 9.0} and row["progreso"]["o1"]["notas"] == "" and row["updated_at"] == T2
    assert [r["semana"] for r in rejected.collect()] == ["2030-01-01"]


def test_the_last_version_of_a_week_counts(spark, stored):
    new = spark.createDataFrame(
        [("2024-01-01", dt.date(2024, 1, 3), {"A": 30.0}, [], None, None, T2), ("2024-01-01", dt.date(2024, 1, 2), {"A": 20.0}, [], None, None, T1),
         ("2024-01-01", dt.date(2024, 1, 4), {"A": 40.0}, [], None, None, None)], tasks.ASSIGNMENTS)
    row = tasks.merge_assignments(stored, new).collect()
    assert [(r["fecha_inicio"], r["metas_sku"], r["updated_at"]) for r in row] == [(dt.date(2024, 1, 3), {"A": 30.0}, T2)]


def test_an_older_report_does_not_replace_a_newer_entry(spark, stored):
    first = spark.createDataFrame([("2024-01-01", "o1", {"A": 9.0}, "new", T2)], tasks.UPDATES)
    merged, _ = tasks.merge_progress(stored, first)
    late = spark.createDataFrame([("2024-01-01", "o1", {"A": 5.0}, "old", T1), ("2024-01-01", "o2", {"A": 1.0}, "", T1)], tasks.UPDATES)
    row = tasks.merge_progress(merged, late)[0].first()
    assert {k: v["notas"] for k, v in row["progreso"].items()} == {"o1": "new", "o2": ""} and row["updated_at"] == T2


def test_rollup_status_and_over_assignment(stored):
    rows = {r["operario_id"]: (r["meta"], r["avance"], r["pct"]) for r in tasks.progress_rollup(stored).collect()}
    assert rows == {"o1": (6.0, 3.0, 50.0), "o2": (6.0, 0.0, 0.0)}
    state = tasks.progress_rollup(stored).select("operario_id", tasks.progress_status("pct").alias("s")).collect()
    assert dict(state) == {"o1": "En progreso", "o2": "Sin iniciar"}
    over = tasks.over_assignment(stored).collect()
    assert [(r["sku"], r["asignado"], r["over"]) for r in over] == [("A", 12.0, True)]
    assert tasks.progress_by_sku(stored).where("operario_id = 'o1'").first()["pct"] == 50.0


def test_listing_and_token(stored):
    assert tasks.week_listing(stored).first()["n_operarios"] == 2
    assert tasks.assignment_by_token(stored, "tok-o2").first()["operario"]["nombre"] == "luz"
    assert tasks.assignment_by_token(stored, "nope").count() == 0
