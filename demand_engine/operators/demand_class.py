"""Demand classification by interval and variability (K1-K3), after Syntetos and Boylan (2005)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Published thresholds and the names of the groups.
ADI_LIMIT = 1.32
CV2_LIMIT = 0.49
GROUP_1 = "GRUPO_1_ERRATIC"
GROUP_2 = "GRUPO_2_INTERMITTENT"


def adi_cv2(series: DataFrame) -> DataFrame:
    """K1 on a weekly series (sku, week_start, salida); the usual input is dense and zero-filled.

    ADI is infinite, and CV null, for a SKU that never had demand; with a single demand week the
    standard deviation, and so CV, is null.
    """
    demand = F.when(F.col("salida") > 0, F.col("salida"))
    stats = series.groupBy("sku").agg(
        F.count("*").alias("semanas_totales"),
        F.count(demand).alias("semanas_con_demanda"),
        F.mean(demand).alias("media_demanda"),
        F.stddev_samp(demand).alias("std_demanda"),
    )
    some = F.col("semanas_con_demanda") > 0
    return (
        stats.withColumn(
            "adi",
            F.when(some, F.try_divide(F.col("semanas_totales"), F.col("semanas_con_demanda"))).otherwise(
                F.lit(float("inf"))
            ),
        )
        .withColumn("cv", F.try_divide("std_demanda", "media_demanda"))
        .withColumn("cv2", F.col("cv") * F.col("cv"))
        .withColumn("pct_semanas_demanda", 100 * F.col("semanas_con_demanda") / F.col("semanas_totales"))
        .fillna(0.0, ["media_demanda"])
    )


def classify_demand(stats: DataFrame, adi: float = ADI_LIMIT, cv2: float = CV2_LIMIT) -> DataFrame:
    """K2. An unknown CV² makes the class hybrid; ADI exactly at the limit counts as intermittent."""
    often, seldom = F.col("adi") < adi, F.col("adi") > adi
    wild, steady = F.col("cv2") > cv2, F.col("cv2") < cv2
    kind = (
        F.when(often & wild, "ERRATIC")
        .when(seldom & steady, "INTERMITTENT")
        .when(often, "HYBRID_ERRATIC")
        .otherwise("HYBRID_INTERMITTENT")
    )
    return stats.withColumn("cluster", kind).withColumn(
        "grupo", F.when(F.col("cluster").endswith("ERRATIC"), GROUP_1).otherwise(GROUP_2)
    )


def cluster_summary(classes: DataFrame) -> DataFrame:
    """K3: per group number of products and means. The members are the rows of K2 themselves."""
    return classes.groupBy("grupo").agg(
        F.count("*").alias("productos"),
        F.mean(F.round("adi", 4)).alias("adi_promedio"),
        F.mean(F.round("cv2", 4)).alias("cv2_promedio"),
        F.mean(F.round("pct_semanas_demanda", 2)).alias("pct_semanas_promedio"),
    )
