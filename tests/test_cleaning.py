import pytest

from demand_engine.operators import cleaning, outliers


def test_balanced_guide_leaves_and_sale_stays(ledger):
    df = ledger(
        {"salida": 50.0, "entrada": 50.0, "documento": "Guía de remisión - R001", "numero": "10"},
        {"salida": 100.0, "documento": "Venta", "numero": "11"},
    )
    rows = cleaning.exclude_balanced_guides(df).collect()
    assert [r["salida"] for r in rows] == [100.0]


def test_guides_balance_over_their_whole_number_and_ignore_case(ledger):
    df = ledger(
        {"salida": 30.0, "documento": "GUÍA DE REMISIÓN - R9", "numero": "7"},
        {"entrada": 30.0, "documento": "Guía de remisión - R9", "numero": "7"},
        {"salida": 5.0, "documento": "Venta", "numero": "7"},
        {"salida": 4.0, "entrada": 3.0, "documento": "Guía de remisión - R1", "numero": "8"},
    )
    rows = cleaning.exclude_balanced_guides(df).collect()
    assert sorted(r["salida"] for r in rows) == [4.0, 5.0]


def test_guides_without_number_are_never_removed(ledger):
    df = ledger(
        {"salida": 5.0, "entrada": 5.0, "documento": "Guía de remisión - R", "numero": None},
        {"salida": 1.0, "documento": None, "numero": None},
    )
    assert cleaning.exclude_balanced_guides(df).count() == 2


def test_second_guide_pattern_is_optional(ledger):
    df = ledger({"salida": 5.0, "entrada": 5.0, "documento": "GUIA ELECTRONICA-REM 1", "numero": "3"})
    assert cleaning.exclude_balanced_guides(df, cleaning.GUIDES_SHORT).count() == 1
    assert cleaning.exclude_balanced_guides(df, cleaning.GUIDES_LONG).count() == 0


def test_transfers_leave_but_missing_documents_stay(ledger):
    df = ledger({"documento": "TRASPASO ENTRE ALMACENES"}, {"documento": None}, {"documento": "Venta"})
    assert cleaning.exclude_transfers(df).count() == 2


def test_types_are_coerced(spark):
    raw = spark.createDataFrame([("12.5", None, "x", "2023-02-30"), ("a", "3", "1", "2023-02-28")], "entrada string, salida string, saldo string, fecha string")
    rows = cleaning.coerce_types(raw).collect()
    assert [(r["entrada"], r["salida"], r["saldo"]) for r in rows] == [(12.5, 0.0, 0.0), (0.0, 3.0, 1.0)]
    assert rows[0]["fecha"] is None and str(rows[1]["fecha"]) == "2023-02-28"


def test_defaults_and_codes(ledger):
    df = ledger({"sku": "'cer 001", "bodega": None, "canal": None, "cliente": None, "documento": None})
    row = cleaning.with_normalized_sku(cleaning.fill_dimension_defaults(df)).first()
    assert (row["sku"], row["bodega"], row["canal"]) == ("CER001", "Sin asignar", "Sin canal")
    assert cleaning.only_skus(df).count() == 1
    assert cleaning.critical_only(df, None).count() == 1


def test_last_weeks_and_since(series):
    weeks = series({"a": range(10)})
    assert [r["salida"] for r in cleaning.last_n_weeks(weeks, 3).collect()] == [9, 8, 7]
    assert cleaning.last_n_weeks(weeks, 0).count() == 10
    assert cleaning.since(weeks, "2022-01-17").count() == 8


def test_cap_needs_four_positive_movements(ledger):
    few = [{"sku": "few", "salida": v} for v in (1.0, 1.0, 1000.0)]
    many = [{"sku": "many", "salida": float(v)} for v in [*range(1, 101), 5000]]
    out = outliers.cap_p99(ledger(*few, *many))
    assert out.where("sku = 'few' and salida_capped").count() == 0
    import numpy as np

    cap = np.quantile([*range(1, 101), 5000], 0.99)
    hit = out.where("salida_capped").collect()
    assert [r["salida"] for r in hit] == [pytest.approx(cap)]
    assert out.where("entrada_capped").count() == 0


def test_iqr_replacement_uses_original_bounds(ledger):
    values = [10.0, 11.0, 12.0, 13.0, 14.0, 500.0, 0.0]
    out = outliers.replace_iqr_outliers(ledger(*[{"salida": v} for v in values]))
    assert sorted(r["salida"] for r in out.collect()) == [0.0, 10.0, 11.0, 12.0, 12.5, 13.0, 14.0]
    report = {r["sku"]: r["outliers"] for r in outliers.outlier_report(out).collect()}
    assert report == {"P1": 1, None: 1}
