"""Second moments of many columns in one pass: correlations, Gram matrix, p-values."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = "a string, b string, n double, sa double, sb double, saa double, sbb double, sab double"


def pair_sums(df: DataFrame, columns: list[str], targets: list[str] | None = None, centre: bool = True) -> DataFrame:
    """Sums over the rows where both columns are known, for each pair of columns.

    Every Arrow batch is reduced to one k x k block with matrix products, so the shuffle carries
    k x k rows per batch whatever the number of rows. Columns are first moved by their mean (one
    small aggregate of k numbers), which keeps the sums well conditioned. ``targets`` limits the
    second column of the pairs.
    """
    numeric = df.select(*[F.col(c).try_cast("double").alias(c) for c in columns])
    others = targets or columns
    shift = {c: 0.0 for c in columns}
    if centre:
        means = numeric.agg(*[F.mean(F.when(~F.isnan(c), F.col(c))).alias(c) for c in columns]).first()
        shift = {c: means[c] or 0.0 for c in columns}
    offsets = np.array([shift[c] for c in columns])
    picked = [columns.index(c) for c in others]

    def reduce_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            x = batch.to_numpy(dtype=float, na_value=np.nan) - offsets
            known = np.isfinite(x)
            x = np.where(known, x, 0.0)
            m = known.astype(float)
            y, my = x[:, picked], m[:, picked]
            block = np.stack([m.T @ my, x.T @ my, m.T @ y, (x * x).T @ my, m.T @ (y * y), x.T @ y])
            total = block if total is None else total + block
        if total is not None:
            rows, cols = np.meshgrid(np.arange(len(columns)), np.arange(len(others)), indexing="ij")
            out = pd.DataFrame({"a": np.array(columns)[rows.ravel()], "b": np.array(others)[cols.ravel()]})
            for name, values in zip(("n", "sa", "sb", "saa", "sbb", "sab"), total, strict=True):
                out[name] = values.ravel()
            yield out

    parts = numeric.mapInPandas(reduce_batches, _BLOCK)
    return parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])


def indicator_sums(indicators: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """``pair_sums`` of each indicator (a) with each column (b), from the sparse form: rows (sku, week_start, feature) that are 1.

    An indicator is 0 in the other weeks of the SKUs that ever have it, and unknown for other SKUs. So what it takes is sums per
    SKU, joined to the SKUs that have it, and sums over the weeks in which it is 1; no row is made for a 0.
    """
    numeric = df.select("sku", "week_start", *[F.col(c).try_cast("double").alias(c) for c in columns])
    numeric = numeric.select("sku", "week_start", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in columns])
    means = numeric.agg(*[F.mean(c).alias(c) for c in columns]).first()  # k numbers
    moved = numeric.select("sku", "week_start", *[(F.col(c) - (means[c] or 0.0)).alias(c) for c in columns])

    def listed(**sums) -> Column:
        return F.array(*[F.struct(F.lit(c).alias("b"), *[f(F.col(c)).cast("double").alias(k) for k, f in sums.items()]) for c in columns])

    by_sku = moved.groupBy("sku").agg(listed(n=F.count, sb=F.sum, sbb=lambda x: F.sum(x * x)).alias("s"))
    around = indicators.select("sku", F.col("feature").alias("a")).distinct().join(by_sku, "sku").select("a", F.explode("s").alias("s"))
    around = around.groupBy("a", "s.b").agg(*[F.sum(f"s.{c}").alias(c) for c in ("n", "sb", "sbb")])
    hits = indicators.select("sku", "week_start", F.col("feature").alias("a")).join(moved, ["sku", "week_start"])
    inside = hits.groupBy("a").agg(listed(sa=F.count, sab=F.sum).alias("s")).select("a", F.explode("s").alias("s")).select("a", "s.b", "s.sa", "s.sab")
    return around.join(inside, ["a", "b"]).withColumns({"saa": F.col("sa"), "sab": F.coalesce("sab", F.lit(0.0))})


def indicator_pair_sums(indicators: DataFrame, df: DataFrame) -> DataFrame:
    """``pair_sums`` of each two indicators (a < b) that some SKU has both of: common weeks from a join on (SKU, week)."""
    weeks = df.groupBy("sku").agg(F.count("*").cast("double").alias("n"))
    own = indicators.groupBy("sku", "feature").agg(F.count("*").cast("double").alias("m")).join(weeks, "sku")
    one, two = own.toDF("sku", "a", "sa", "n"), own.drop("n").toDF("sku", "b", "sb")
    both = one.join(two, "sku").where("a < b").groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb")])
    left, right = indicators.select("sku", "week_start", F.col("feature").alias("a")), indicators.select("sku", "week_start", F.col("feature").alias("b"))
    common = left.join(right, ["sku", "week_start"]).where("a < b").groupBy("a", "b").agg(F.count("*").cast("double").alias("sab"))
    return both.join(common, ["a", "b"], "left").withColumns({"saa": F.col("sa"), "sbb": F.col("sb"), "sab": F.coalesce("sab", F.lit(0.0))})


def pearson(sums: DataFrame) -> DataFrame:
    """``a, b, n, r`` from pair sums; r is null for a constant column or fewer than two rows."""
    va = F.col("saa") - F.col("sa") * F.col("sa") / F.nullif("n", F.lit(0.0))
    vb = F.col("sbb") - F.col("sb") * F.col("sb") / F.nullif("n", F.lit(0.0))
    cov = F.col("sab") - F.col("sa") * F.col("sb") / F.nullif("n", F.lit(0.0))
    # A constant column leaves only rounding noise behind.
    flat = (va <= 1e-12 * F.col("saa")) | (vb <= 1e-12 * F.col("sbb"))
    r = F.when((F.col("n") >= 2) & ~flat, F.try_divide(cov, F.sqrt(va * vb)))
    inside = F.when(F.abs(r) <= 1, r).otherwise(F.signum(r))
    return sums.select("a", "b", F.col("n").cast("long").alias("n"), inside.alias("r"))


TINY = 1e-300


def _gamma_ratio(a: Column) -> Column:
    """Gamma(a + 1/2) / Gamma(a) for a > 0: the asymptotic series at a + 16, brought down by the recurrence."""
    z = a + 16.0
    series = F.sqrt(z) * (1 - 1 / (8 * z) + 1 / (128 * z * z) + 5 / (1024 * z * z * z) - 21 / (32768 * z * z * z * z))
    return F.aggregate(F.sequence(F.lit(0), F.lit(15)), series, lambda product, i: product * (a + i) / (a + i + 0.5))


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function (Lentz's method), folded term by term.

    It settles after some multiple of the root of the larger parameter, so the fold is that long and no longer.
    """
    def held(v: Column) -> Column:
        return F.when(F.abs(v) < TINY, F.lit(TINY)).otherwise(v)

    def state(c: Column, d: Column, h: Column) -> Column:
        return F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

    def step(s: Column, k: Column) -> Column:
        m = F.floor((k + 1) / 2).cast("double")
        odd = -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        term = F.when(k % 2 == 1, odd).otherwise(even)
        c, d = held(1.0 + term / s["c"]), 1.0 / held(1.0 + term * s["d"])
        return state(c, d, s["h"] * c * d)

    terms = (F.lit(200) + 12 * F.sqrt(F.greatest(a, b))).cast("int")
    first = 1.0 / held(1.0 - (a + b) * x / (a + 1))
    return F.aggregate(F.sequence(F.lit(2), terms), state(F.lit(1.0), first, first), step, lambda s: s["h"])


def correlation_p_value(r: Column | str, n: Column | str) -> Column:
    """Two-sided p-value of a correlation over n rows: t with n - 2 degrees of freedom, 1 where there are none.

    It is the regularised incomplete beta function of 1 - r^2 at ((n - 2) / 2, 1/2), as expressions for the few rows of a
    result table.
    """
    r, n = (F.col(v) if isinstance(v, str) else v for v in (r, n))
    a, x = (n.cast("double") - 2) / 2, F.greatest(F.lit(0.0), 1 - r * r)
    low = x < (a + 1) / (a + 2.5)
    first, second, at = F.when(low, a).otherwise(0.5), F.when(low, 0.5).otherwise(a), F.when(low, x).otherwise(1 - x)
    front = F.exp(a * F.ln(x) + 0.5 * F.ln(1 - x)) * _gamma_ratio(a) / math.sqrt(math.pi)
    part = front * _beta_fraction(first, second, at) / first
    inside = F.when(low, part).otherwise(1 - part)
    return F.when(r.isNull() | F.isnan(r) | (a <= 0), 1.0).when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inside)
