from demand_engine.operators import pareto, profiles, rollups


def test_zero_sales_select_nothing(ledger):
    curve = pareto.pareto_curve(ledger({"sku": "P1"}, {"sku": "P2"}))
    assert pareto.pareto_cut(curve).first().asDict() == {"products": 2, "products_80": 0, "products_90": 0}
    assert pareto.pareto_summary(curve).first()["critical_pct"] is None


def test_empty_ledger(ledger):
    df = ledger({"sku": "P1"}).where("false")
    assert pareto.pareto_curve(df).count() == 0
    assert pareto.pareto_summary(pareto.pareto_curve(df)).first()["coverage_80"] is None


def test_single_product_is_always_selected(ledger):
    curve = pareto.pareto_curve(ledger({"salida": 500.0}))
    assert curve.first()["cum_pct"] == 100.0
    assert pareto.pareto_cut(curve).first()["products_80"] == 1


def test_the_product_that_crosses_the_level_is_left_out(ledger):
    curve = pareto.pareto_curve(ledger(*[{"sku": s, "salida": v} for s, v in (("a", 79.0), ("b", 2.0), ("c", 19.0))]))
    assert {r["sku"] for r in curve.where("in_80").collect()} == {"a"}


def test_profiles_skip_missing_codes_and_keep_the_first_description(ledger):
    df = ledger(
        {"salida": 5.0, "descripcion": "later", "fecha": "2023-02-01"},
        {"salida": 3.0, "descripcion": None, "fecha": "2023-01-01"},
        {"salida": 2.0, "descripcion": "first", "fecha": "2023-01-15"},
        {"sku": None, "salida": 9.0},
    )
    rows = profiles.sales_by_product(df, ["fecha", "numero"]).collect()
    assert len(rows) == 1 and rows[0]["descripcion"] == "first" and rows[0]["salida_total"] == 10.0


def test_main_warehouse_tie_and_rotation_of_empty_stock(ledger):
    df = ledger({"bodega": "Z", "salida": 4.0}, {"bodega": "A", "salida": 4.0})
    stock = profiles.stock_by_product(df)
    assert stock.first()["bodega_principal"] == "A"
    rotation = profiles.inventory_rotation(profiles.sales_by_product(df, ["fecha"]), stock).first()
    assert rotation["rotacion"] == 8.0


def test_top_products_breaks_ties_by_code(ledger):
    df = ledger(*[{"sku": s, "salida": 1.0} for s in "dcba"])
    assert [r["sku"] for r in profiles.top_products(df, 2).collect()] == ["a", "b"]


def test_top_clients_share_is_of_the_listed_ones(ledger):
    df = ledger(*[{"cliente": c, "salida": v} for c, v in (("x", 60.0), ("y", 20.0), (" ", 20.0), ("z", 1.0))])
    rows = rollups.top_clients(df, 3).collect()
    assert [(r["cliente"], r["acumulado_pct"]) for r in sorted(rows, key=lambda r: r["puesto"])] == [
        ("x", 60.0), ("Desconocido", 80.0), ("y", 100.0)]
