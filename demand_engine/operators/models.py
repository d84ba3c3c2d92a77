"""Model search per SKU: usable features, folds, grids, scores and winners."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demand_engine.functions.expressions import beside
from demand_engine.functions.regressors import Moments, Ridge, indicators, usable
from demand_engine.session import keep_table

# The parameter grids.
RIDGE_GRID = {"alpha": [1.0, 10.0, 100.0]}
FULL_GRID = {"Ridge": RIDGE_GRID}
MAPE_CAP = 200.0
ALGORITHMS = {"Ridge": Ridge}


def make(algorithm: str, params: dict[str, float]):
    return ALGORITHMS[algorithm](**params)


def usable_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """Features with at least two numeric values per SKU (null counts as 0, text as nothing).

    A SKU without any gets one row with ``feature = null`` and the reason in ``error``.
    """
    counts = df.groupBy("sku").agg(
        *[F.count(F.coalesce(F.col(c).cast("string"), F.lit("0")).try_cast("double")).alias(c) for c in columns]
    )
    usable = F.filter(F.array(*[F.when(F.col(c) >= 2, F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    return counts.select("sku", F.explode_outer(usable).alias("feature")).withColumn(
        "error", F.when(F.col("feature").isNull(), "No numeric cols")
    )


def time_series_folds(df: DataFrame, max_folds: int = 5) -> DataFrame:
    """Expanding-window folds. Each row appears once per fold it takes part in, with ``is_train``.

    k = min(5, max(2, n // 4)) folds; the tests are the last k blocks of n // (k+1) weeks, and a
    fold trains on everything before its test. ``fold`` counts from 0.
    """
    series = W.partitionBy("sku").orderBy("week_start")
    n = F.count("*").over(series.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    placed = (
        df.withColumns({"_i": F.row_number().over(series) - 1, "_n": n})
        .withColumn("_k", F.least(F.lit(max_folds), F.greatest(F.lit(2), F.floor(F.col("_n") / 4))).cast("int"))
        .withColumn("_size", F.floor(F.col("_n") / (F.col("_k") + 1)).cast("int"))
        .withColumn("fold", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
        .withColumn("_start", F.col("_n") - (F.col("_k") - F.col("fold")) * F.col("_size"))
    )
    kept = placed.where(F.col("_i") < F.col("_start") + F.col("_size"))
    return kept.withColumn("is_train", F.col("_i") < F.col("_start")).drop("_i", "_n", "_k", "_size", "_start")


def fold_bounds(n: int, max_folds: int = 5) -> list[tuple[int, int]]:
    """(start, end) of each test block of a series of n rows; the rule of ``time_series_folds``."""
    k = min(max_folds, max(2, n // 4))
    size = n // (k + 1)
    return [(n - (k - f) * size, n - (k - f - 1) * size) for f in range(k)] if size else []


def candidates(grid: dict[str, dict[str, list]]) -> list[dict]:
    """Every parameter combination, numbered in grid order per algorithm."""
    out = []
    for algorithm, options in grid.items():
        for i, values in enumerate(itertools.product(*options.values())):
            out.append({"algorithm": algorithm, "candidate": i, "params": dict(zip(options, values, strict=True))})
    return out


PREDICTIONS = "sku string, algorithm string, candidate int, fold int, week_start date, y double, yhat double"


def numeric(columns: list[str]) -> list[Column]:
    """Features as numbers; null counts as 0, text that is no number as not a number."""
    return [F.coalesce(F.col(c).cast("string"), F.lit("0")).try_cast("double").alias(c) for c in columns]


def texts(columns: Iterable[str]) -> list[Column]:
    return [F.col(c).cast("string").alias(c) for c in columns]


def cross_validate(df: DataFrame, columns: list[str], grid: dict | None = None, categories: Iterable[str] = ()) -> DataFrame:
    """Out-of-fold predictions of every candidate, per SKU, on the columns that are usable there.

    ``categories`` are text columns; the values that a SKU has become its indicators (G14), made inside its group, so their
    number over all SKUs doesn't matter.

    One group per SKU: a series has a few hundred weeks. Each row enters the running moments once, after the last fold that
    it is tested in, and a fold's penalties share one factorisation. A SKU without a usable column has no row.
    """
    listed, categories = candidates(grid or FULL_GRID), list(categories)
    alphas = [c["params"]["alpha"] for c in listed]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("week_start")
        x, y, weeks = pdf[columns].to_numpy(dtype=float), pdf["_y"].to_numpy(dtype=float), pdf["week_start"].to_numpy()
        x = np.hstack([np.nan_to_num(x[:, usable(x)]), indicators([pdf[c].to_numpy(object) for c in categories]) if categories else x[:, :0]])
        parts = [pd.DataFrame(columns=["sku", "algorithm", "candidate", "fold", "week_start", "y", "yhat"])]
        so_far, done = Moments(x.mean(axis=0), y.mean()), 0
        for fold, (start, end) in enumerate(fold_bounds(len(y)) if x.shape[1] else []):
            weights, intercepts = so_far.add(x[done:start], y[done:start]).ridge(alphas)
            done = start
            yhat = x[start:end] @ weights + intercepts
            for k, c in enumerate(listed):
                parts.append(pd.DataFrame({"sku": key[0], "algorithm": c["algorithm"], "candidate": np.int32(c["candidate"]),
                                           "fold": np.int32(fold), "week_start": weeks[start:end], "y": y[start:end], "yhat": yhat[:, k]}))
        return pd.concat(parts[1:] or parts, ignore_index=True)

    data = df.select("sku", "week_start", F.col("salida").cast("double").alias("_y"), *numeric(columns), *texts(categories))
    return data.groupBy("sku").applyInPandas(run, PREDICTIONS)


def capped_mape(y, yhat):
    """W8 as an aggregate: mean of |error| / y in percent over y > 0, each at most 200; 0 if none."""
    error = F.least(F.lit(MAPE_CAP), F.abs((y - yhat) / F.when(y > 0, y)) * 100)
    return F.coalesce(F.mean(F.when(y > 0, error)), F.lit(0.0))


def score_folds(predictions: DataFrame) -> DataFrame:
    """R², MAE, RMSE and capped MAPE per (SKU, algorithm, candidate, fold)."""
    y, yhat = F.col("y"), F.col("yhat")
    sums = predictions.groupBy("sku", "algorithm", "candidate", "fold").agg(
        F.sum((y - yhat) * (y - yhat)).alias("_res"),
        (F.var_pop(y) * F.count("*")).alias("_tot"),
        F.mean(F.abs(y - yhat)).alias("mae"),
        F.sqrt(F.mean((y - yhat) * (y - yhat))).alias("rmse"),
        capped_mape(y, yhat).alias("mape"),
    )
    constant = F.when(F.col("_res") == 0, 1.0).otherwise(0.0)
    return sums.withColumn(
        "r2", F.when(F.col("_tot") > 0, 1 - F.try_divide("_res", "_tot")).otherwise(constant)
    ).drop("_res", "_tot")


def mean_scores(fold_scores: DataFrame) -> DataFrame:
    """Mean over the folds."""
    return fold_scores.groupBy("sku", "algorithm", "candidate").agg(
        *[F.mean(m).alias(m) for m in ("r2", "mae", "rmse", "mape")]
    )


def _preference(order: Iterable[str]):
    ranks = F.create_map(*[F.lit(x) for i, a in enumerate(order) for x in (a, i)])
    return F.coalesce(ranks[F.col("algorithm")], F.lit(10**6))


def best_candidates(scores: DataFrame) -> DataFrame:
    """Best candidate of each algorithm by mean R² (ties: the earlier in the grid)."""
    best = F.max_by(F.struct("candidate", "r2", "mae", "rmse", "mape"), F.struct(F.col("r2"), -F.col("candidate")))
    return scores.groupBy("sku", "algorithm").agg(best.alias("_b")).select("sku", "algorithm", "_b.*")


def select_winner(best: DataFrame, order: Iterable[str] = tuple(ALGORITHMS)) -> DataFrame:
    """The algorithm with the highest mean R² per SKU (ties: the given order)."""
    row = F.struct("algorithm", "candidate", "r2", "mae", "rmse", "mape")
    return best.groupBy("sku").agg(F.max_by(row, F.struct(F.col("r2"), -_preference(order))).alias("_w")).select("sku", "_w.*")


def with_params(best: DataFrame, grid: dict | None = None) -> DataFrame:
    """Adds ``params`` (map) of each chosen candidate; the grid is a fixed, small table."""
    rows = [(c["algorithm"], c["candidate"], {k: float(v) for k, v in c["params"].items()}) for c in candidates(grid or FULL_GRID)]
    listed = best.sparkSession.createDataFrame(rows, "algorithm string, candidate int, params map<string,double>")
    return best.join(F.broadcast(listed), ["algorithm", "candidate"], "left")


def search(
    df: DataFrame, columns: list[str], grid: dict | None = None, keep: Callable[[DataFrame], DataFrame] = keep_table, categories: Iterable[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """(best candidate per SKU and algorithm, winner per SKU), both with their parameters.

    Both come from the same predictions, and the search is the costly part: ``keep`` writes its result.
    """
    best = keep(with_params(best_candidates(mean_scores(score_folds(cross_validate(df, columns, grid, categories)))), grid))
    return best, with_params(select_winner(best), grid)


def model_comparison(best: DataFrame, algorithms: Iterable[str] = tuple(ALGORITHMS)) -> DataFrame:
    """R² by algorithm side by side, one row per SKU."""
    return best.groupBy("sku").pivot("algorithm", list(algorithms)).agg(F.max("r2"))


def winner_tally(winners: DataFrame) -> DataFrame:
    """How often each algorithm wins; ``most_frequent`` marks the first."""
    counts = winners.groupBy("algorithm").agg(F.count("*").alias("wins"))
    top = counts.agg(F.max_by("algorithm", F.struct(F.col("wins"), -_preference(ALGORITHMS))).alias("_top"))
    return beside(counts, top).withColumn("most_frequent", F.col("algorithm") == F.col("_top")).drop("_top")


def mean_r2(best: DataFrame) -> DataFrame:
    """Mean R² per algorithm."""
    return best.groupBy("algorithm").agg(F.mean("r2").alias("mean_r2"))
