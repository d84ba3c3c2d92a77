"""Wide tables whose columns come from the data."""

import pytest
from pyspark.sql import functions as F

from demand_engine.functions.wide import tiles, wide
from demand_engine.operators import forecast, materials, rollups


def test_a_new_sku_gets_its_column(spark):
    rows = [(f"Brand#{i}", y, float(i * y)) for i in range(1, 27) for y in (1, 2)] + [("only", 2, 5.0)]
    df = spark.createDataFrame(rows, "sku string, anio int, ventas double")
    out = rollups.yearly_wide(df)
    assert set(out.columns) == {"anio", "only", *[f"Brand#{i}" for i in range(1, 27)]}
    got = {r["anio"]: r.asDict() for r in out.collect()}
    assert got[1]["Brand#26"] == 26.0 and got[1]["only"] is None and got[2]["only"] == 5.0
    assert rollups.yearly_wide(df, ["Brand#3"]).columns == ["anio", "Brand#3"]


@pytest.mark.parametrize("build", [
    lambda df: rollups.seasonality_wide(df.select(F.col("h").alias("mes"), "sku", F.col("v").alias("indice"))),
    lambda df: forecast.forecast_pivot(df.withColumnRenamed("v", "prediction")).drop("semana"),
    lambda df: materials.plan_cost_matrix(df.withColumnRenamed("v", "cost")),
])
def test_every_wide_table_takes_its_columns_from_the_data(spark, build):
    df = spark.createDataFrame([(1, "b", 2.0), (1, "a", 3.0), (2, "a", 4.0), (2, None, 9.0)], "h int, sku string, v double")
    out = build(df)
    assert out.columns[1:] == ["a", "b"] and sorted(r["a"] for r in out.collect()) == [3.0, 4.0]


def test_a_wide_catalogue_in_tiles(spark):
    df = spark.range(1200).selectExpr("concat('s', id) AS sku", "cast(id % 3 as int) AS h", "cast(id as double) AS v")
    parts = tiles(df, "sku")
    assert [len(p) for p in parts] == [500, 500, 200]
    seen = {}
    for names in parts:
        for r in wide(df, "h", "sku", F.max("v"), names).collect():
            seen |= {c: v for c, v in r.asDict().items() if c != "h" and v is not None}
    assert seen == {f"s{i}": float(i) for i in range(1200)}
