import numpy as np
import pytest
from pyspark.sql import functions as F

from demand_engine.functions.ordering import exact_quantiles, modes, ranked_running_total


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_quantiles_equal_numpy_with_a_hot_key(spark, seed):
    rng = np.random.default_rng(seed)
    groups = {"hot": np.exp(rng.normal(3, 2, 5000)), "ties": rng.integers(1, 4, 900).astype(float), "one": np.array([7.0]),
              "two": np.array([1.0, 4.0])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("hot", 0.0), ("hot", -5.0), ("none", 0.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    probs = {"a": 0.25, "b": 0.5, "c": 0.99, "lo": 0.0, "hi": 1.0}
    out = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", probs).collect()}
    assert set(out) == set(groups)
    for k, vs in groups.items():
        assert out[k]["n"] == len(vs)
        for name, p in probs.items():
            assert out[k][name] == pytest.approx(np.quantile(vs, p), rel=1e-12)


def test_running_total_equals_a_plain_sort(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.integers(0, 50, 300), [5] * 200, [0] * 20, rng.random(50) * 1e6]).astype(float)
    rows = [(f"s{i:04d}", float(v)) for i, v in enumerate(values)]
    out = ranked_running_total(spark.createDataFrame(rows, "s string, v double"), "v", "s").orderBy("rank").collect()
    expected = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert [r["s"] for r in out] == [s for s, _ in expected]
    assert [r["rank"] for r in out] == list(range(1, len(rows) + 1))
    assert np.allclose([r["running"] for r in out], np.cumsum([v for _, v in expected]))


def test_modes_break_ties_by_the_smallest_value(spark):
    rows = [("a", "x", None), ("a", "y", None), ("a", "y", "q"), ("b", "z", "r"), ("b", "c", "r"), ("c", None, None)]
    out = {r["k"]: (r["u"], r["v"]) for r in modes(spark.createDataFrame(rows, "k string, u string, v string"), ["k"], ["u", "v"]).collect()}
    assert out == {"a": ("y", "q"), "b": ("c", "r")}


def test_no_task_holds_a_whole_hot_key(spark):
    """Ordering happens per (key, value bucket): the largest ordered group is a small part of the key."""
    from demand_engine.functions.expressions import magnitude_bucket

    df = spark.range(100000).select((F.exp(F.randn(5) * 2)).alias("v"))
    largest = df.groupBy(magnitude_bucket("v").alias("b")).count().agg(F.max("count")).first()[0]
    assert largest < 1000


def test_equal_totals_are_dealt_to_many_tasks(spark):
    items = spark.range(40000).select(F.format_string("s%05d", "id").alias("s"), F.lit(1.0).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ranked_running_total(items, "v", "s")
        sizes = out.groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) > 1 and max(r["count"] for r in sizes) < 30000
        wrong = out.where((F.col("rank") != F.substring("s", 2, 5).cast("int") + 1) | (F.col("running") != F.col("rank")))
        assert wrong.count() == 0 and out.count() == 40000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
