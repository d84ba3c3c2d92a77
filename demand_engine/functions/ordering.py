"""Exact quantiles, ranks and running totals that never put one whole group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demand_engine.functions.expressions import magnitude_bucket
from demand_engine.session import keep_table


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles of the positive values per key.

    Returns ``keys, n, <one column per prob>``. Works on counts per distinct value (combined on the
    map side). A coarse histogram of geometric value buckets tells which buckets hold the wanted
    ranks; only those buckets are ordered, each on its own. A key with a third of all rows is so
    spread over its buckets, and no task or buffer holds a key's values together. Null keys drop.
    """
    known = F.col(value) > 0
    for k in keys:  # the same for both uses of the counts below, so they share one exchange
        known = known & F.col(k).isNotNull()
    values = (
        df.where(known)
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count("*").alias("_c"))
        .withColumn("_b", magnitude_bucket("_v"))
    )
    by_key = W.partitionBy(*keys)
    histogram = (
        values.groupBy(*keys, "_b")
        .agg(F.sum("_c").alias("_bc"))
        .withColumn("n", F.sum("_bc").over(by_key))
        .withColumn("_end", F.sum("_bc").over(by_key.orderBy("_b").rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("_start", F.col("_end") - F.col("_bc"))
    )
    ranks = {}  # 0-based rank of the lower and upper neighbour of each quantile
    for name, p in probs.items():
        position = F.lit(p) * (F.col("n") - 1)
        ranks[f"{name}_lo"] = F.floor(position)
        ranks[f"{name}_hi"] = F.ceil(position)
    wanted = [(F.col("_start") <= r) & (r < F.col("_end")) for r in ranks.values()]
    hit = wanted[0]
    for w in wanted[1:]:
        hit = hit | w
    targets = histogram.where(hit).select(*keys, "_b", "n", "_start")
    inside = W.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    located = (
        values.join(targets, [*keys, "_b"])
        .withColumn("_to", F.col("_start") + F.sum("_c").over(inside))
        .withColumn("_from", F.col("_to") - F.col("_c"))
    )
    picks = [
        F.max(F.when((F.col("_from") <= r) & (r < F.col("_to")), F.col("_v"))).alias(name) for name, r in ranks.items()
    ]
    found = located.groupBy(*keys).agg(F.max("n").alias("n"), *picks)
    result = []
    for name, p in probs.items():
        position = F.lit(p) * (F.col("n") - 1)
        step = position - F.floor(position)
        result.append((F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * step).alias(name))
    return found.select(*keys, "n", *result)


def ranked_running_total(
    df: DataFrame, value: str, tie: str, rank: str = "rank", running: str = "running", total: str = "total_all"
) -> DataFrame:
    """Global rank and running total by ``value`` descending (ties by ``tie`` ascending), and the total.

    ``df`` has one row per item. The items are written, dealt by ranges of (value, tie), and ordered within each
    range; only the totals of the ranges pass through one window. Equal values spread over ranges like any others.
    """
    items = keep_table(df, "items")
    ranged = items.repartitionByRange(F.desc(value), F.asc(tie)).withColumn("_b", F.spark_partition_id())
    parts = keep_table(ranged, "ranges")
    totals = parts.groupBy("_b").agg(F.count("*").alias("_n"), F.sum(value).alias("_s"))
    order = W.orderBy("_b")
    before, every = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    offsets = totals.select(
        "_b",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_s0"),
        F.sum("_s").over(every).alias(total),
    )
    inside = W.partitionBy("_b").orderBy(F.desc(value), F.asc(tie))
    return (
        parts.join(offsets, "_b")
        .withColumn(rank, F.col("_n0") + F.row_number().over(inside))
        .withColumn(running, F.col("_s0") + F.sum(value).over(inside.rowsBetween(W.unboundedPreceding, 0)))
        .drop("_b", "_n0", "_s0")
    )


def modes(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Most frequent non-null value of each column per key; ties go to the smallest value.

    Counts per (key, column, value) are combined on the map side first, so a hot key only ships
    its distinct values. Keys whose columns are all null are absent.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("v")) for i, c in enumerate(columns)]))
    counts = (
        df.select(*keys, pairs.alias("_p"))
        .select(*keys, "_p.i", "_p.v")
        .where(F.col("v").isNotNull())
        .groupBy(*keys, "i", "v")
        .agg(F.count("*").alias("_c"))
    )
    best = F.struct(-F.col("_c"), F.col("v"))
    return counts.groupBy(*keys).agg(
        *[
            F.min_by(F.col("v"), F.when(F.col("i") == i, best)).alias(c)
            for i, c in enumerate(columns)
        ]
    )


def last_known(c: Column | str, window) -> Column:
    return F.last(c, ignorenulls=True).over(window.rowsBetween(W.unboundedPreceding, 0))


def next_known(c: Column | str, window) -> Column:
    return F.first(c, ignorenulls=True).over(window.rowsBetween(0, W.unboundedFollowing))

