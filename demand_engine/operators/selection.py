"""Feature selection: correlation, inflation factors, target correlation, feature sets (V1-V7)."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demand_engine.functions.expressions import beside
from demand_engine.functions.moments import correlation_p_value, indicator_pair_sums, indicator_sums, pair_sums, pearson
from demand_engine.operators import features
from demand_engine.operators.features import KEYS, feature_columns

VIF_LIMIT = 10.0
KEPT_SMOOTHED = ("ma_2", "ma_13")  # of the averages, the shortest and the quarterly one


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """V1: Pearson correlation of every ordered pair of features over their common known rows."""
    return pearson(pair_sums(df, columns or feature_columns(df)))


def high_corr_pairs(matrix: DataFrame, threshold: float = 0.95) -> DataFrame:
    """V2: each unordered pair once (names in order) whose correlation exceeds the threshold."""
    return matrix.where((F.col("a") < F.col("b")) & (F.abs("r") > threshold)).select("a", "b", "r")


def vif(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """V3: variance inflation of each feature, regressed on the others without intercept.

    Columns with unknown values are left out. Spark reduces the rows to the k x k Gram matrix; the
    factor of column i is G_ii (G^-1)_ii. Columns in a linear dependency get infinity.
    """
    names = columns or feature_columns(df)
    sums = pair_sums(df, names, centre=False).collect()  # k x k numbers
    rows = max((s["n"] for s in sums), default=0.0)
    known = {s["a"] for s in sums if s["a"] == s["b"] and s["n"] == rows}
    complete = [c for c in names if c in known]
    place = {c: i for i, c in enumerate(complete)}
    gram = np.zeros((len(complete), len(complete)))
    for s in sums:
        if s["a"] in place and s["b"] in place:
            gram[place[s["a"]], place[s["b"]]] = s["sab"]
    factors = inflation_factors(gram)
    spark = df.sparkSession
    return spark.createDataFrame(
        [(c, None if np.isnan(v) else float(v)) for c, v in zip(complete, factors, strict=True)],
        "feature string, vif double",
    )


def inflation_factors(gram: np.ndarray) -> np.ndarray:
    """Diagonal of G times diagonal of its inverse, infinite along the null space; a zero column has none."""
    scale = np.sqrt(np.diag(gram))
    used = scale > 0
    out = np.full(len(gram), np.nan)
    if not used.any():
        return out
    g = gram[np.ix_(used, used)] / np.outer(scale[used], scale[used])
    values, vectors = np.linalg.eigh(g)
    null = values < 1e-12 * values.max()
    inverse_diagonal = (vectors[:, ~null] ** 2 / values[~null]).sum(axis=1)
    tied = (vectors[:, null] ** 2).sum(axis=1) > 1e-8
    out[used] = np.where(tied, np.inf, inverse_diagonal)
    return out


def target_correlation(df: DataFrame, columns: list[str] | None = None, target: str = "salida") -> DataFrame:
    """V4: correlation with the target and its p-value; (0, 1) where it is not defined."""
    names = columns or feature_columns(df)
    return _with_p_value(pearson(pair_sums(df, [*names, target], [target])).where(F.col("a") != target))


def _with_p_value(r: DataFrame) -> DataFrame:
    return r.select(
        F.col("a").alias("feature"),
        F.coalesce("r", F.lit(0.0)).alias("correlacion"),
        F.when(F.col("r").isNull(), 1.0).otherwise(correlation_p_value("r", "n")).alias("pvalor"),
        F.abs(F.coalesce("r", F.lit(0.0))).alias("abs_corr"),
    )


def indicator_correlation(indicators: DataFrame, df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """V1 for the sparse indicators (G14): correlation of each with each column, and of each two that a SKU has both of."""
    with_columns = pearson(indicator_sums(indicators, df, columns or feature_columns(df)))
    return with_columns.unionByName(pearson(indicator_pair_sums(indicators, df)))


def indicator_target(indicators: DataFrame, df: DataFrame, target: str = "salida") -> DataFrame:
    """V4 for the sparse indicators, however many: correlation with the target and its p-value."""
    return _with_p_value(pearson(indicator_sums(indicators, df, [target])))


def top_by(df: DataFrame, column: str, n: int, name: str = "feature") -> DataFrame:
    """V7: the n largest rows of a feature table (30 and 25 by correlation, 20 by inflation)."""
    return df.orderBy(F.desc_nulls_last(column), name).limit(n)


def feature_roles(names: list[str]) -> dict[str, str]:
    """Roles of the features that have one, as declared beside the features."""
    return {c: r for c in names if (r := features.role(c))}


def feature_sets(names: list[str], problems: list[str]) -> dict[str, list[str]]:
    """V5: conservative (the past, two averages only), intermediate (and what is known ahead), aggressive (everything);
    none has the inflated features."""
    inflated = set(problems)
    by_role: dict[str | None, list[str]] = {}
    for c in names:
        if c not in inflated:
            by_role.setdefault(features.role(c), []).append(c)
    past = [c for c in by_role.get(features.PAST_ROLE, []) if c not in features.SMOOTHED or c in KEPT_SMOOTHED]
    ahead = by_role.get(features.AHEAD_ROLE, [])
    return {"conservative": past, "intermediate": past + ahead, "aggressive": [c for c in names if c not in inflated]}


def set_members(names: list[str], problems: list[str], spark) -> DataFrame:
    """V5 as rows: (feature_set, feature)."""
    rows = [(k, c) for k, columns in feature_sets(names, problems).items() for c in columns]
    return spark.createDataFrame(rows, "feature_set string, feature string")


def problem_features(factors: DataFrame, limit: float = VIF_LIMIT) -> list[str]:
    return [r["feature"] for r in factors.where(F.col("vif") > limit).select("feature").collect()]


def select_sets(df: DataFrame, factors: DataFrame) -> dict[str, DataFrame]:
    """V5: the feature table projected to its base columns and each set."""
    sets = feature_sets(feature_columns(df), problem_features(factors))
    base = [c for c in KEYS if c in df.columns]
    return {name: df.select(*base, *columns) for name, columns in sets.items()}


def selection_summary(df: DataFrame, matrix: DataFrame, factors: DataFrame) -> DataFrame:
    """V6: one row: rows, features, roles, pairs, problems and the size of each set."""
    names = feature_columns(df)
    roles = feature_roles(names)
    sizes = {k: len(v) for k, v in feature_sets(names, problem_features(factors)).items()}
    by_role = {r: sum(1 for v in roles.values() if v == r) for r in ("pasado", "futuro", "temporal")}
    pairs = matrix.where(F.col("a") < F.col("b")).agg(
        F.count_if(F.abs("r") > 0.95).alias("pares_095"), F.count_if(F.abs("r") > 0.90).alias("pares_090")
    )
    bad = factors.agg(F.count_if(F.col("vif") > VIF_LIMIT).alias("features_problema"))
    constants = {"total_features": len(names), **{f"n_{k}": v for k, v in {**by_role, **sizes}.items()}}
    counted = beside(df.agg(F.count("*").alias("total_registros")), pairs, bad)
    return reduce(lambda d, kv: d.withColumn(kv[0], F.lit(kv[1])), constants.items(), counted)
