"""Table, report and forecast files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demand_engine.functions.expressions import normalize_sku

_METRICS = "struct<Algoritmo:string,R2:double,MAE:double,RMSE:double,MAPE:double>"
_COMPARED = "map<string,struct<R2_CV:double,R2:double,MAE:double>>"
REPORT = (
    "sku string, algoritmo_ganador string, hiperparametros_ganador map<string,double>, "
    f"metricas_test {_METRICS}, comparativa {_COMPARED}"
)
REPORT_ENTRY = (
    "struct<algoritmo_ganador:string,hiperparametros_ganador:map<string,double>,"
    f"metricas_test:{_METRICS},comparativa:{_COMPARED}>"
)


def write_table(df: DataFrame, path: str, file_format: str = "parquet") -> None:
    """Parquet, or ``;``-separated latin-1 text on request."""
    if file_format == "csv":
        df.write.mode("overwrite").csv(path, header=True, sep=";", encoding="ISO-8859-1")
    else:
        df.write.mode("overwrite").format(file_format).save(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, sep=";", encoding="ISO-8859-1")


def write_report(df: DataFrame, path: str) -> None:
    """JSON lines, one object per row."""
    df.write.mode("overwrite").json(path)


def write_per_sku(series: DataFrame, path: str, file_format: str = "parquet") -> None:
    """A folder per SKU. Series are short (one row per week), so each SKU is one file."""
    series.repartition("sku").sortWithinPartitions("sku", "week_start").write.mode("overwrite").partitionBy("sku").format(
        file_format
    ).save(path)


def write_forecast_long(forecast: DataFrame, path: str) -> None:
    """The forecast as comma-separated UTF-8 text."""
    forecast.select(
        F.col("sku").alias("Producto_codigo"),
        F.concat(F.lit("W+"), "h").alias("Semana"),
        F.col("prediction").alias("Prediccion"),
        F.col("lower").alias("Lower_Bound_95"),
        F.col("upper").alias("Upper_Bound_95"),
    ).write.mode("overwrite").csv(path, header=True)


def read_forecast_long(spark: SparkSession, path: str) -> DataFrame:
    """A10: (sku, h, prediction, lower, upper); codes normalised, ``W+n`` as a number."""
    raw = spark.read.schema(
        "Producto_codigo string, Semana string, Prediccion double, Lower_Bound_95 double, Upper_Bound_95 double"
    ).csv(path, header=True)
    return raw.select(
        normalize_sku("Producto_codigo").alias("sku"),
        F.regexp_extract("Semana", r"W\+(\d+)", 1).cast("int").alias("h"),
        F.col("Prediccion").alias("prediction"),
        F.col("Lower_Bound_95").alias("lower"),
        F.col("Upper_Bound_95").alias("upper"),
    )


def model_report(best: DataFrame, winners: DataFrame) -> DataFrame:
    """The model report, one nested row per SKU (at most three algorithms each)."""
    compared = best.groupBy("sku").agg(
        F.map_from_entries(
            F.collect_list(
                F.struct(
                    "algorithm",
                    F.struct(
                        F.col("r2").alias("R2_CV"), F.lit(None).cast("double").alias("R2"), F.lit(None).cast("double").alias("MAE")
                    ),
                )
            )
        ).alias("comparativa")
    )
    params: Column = F.col("params") if "params" in winners.columns else F.create_map().cast("map<string,double>")
    return winners.select(
        "sku",
        F.col("algorithm").alias("algoritmo_ganador"),
        params.alias("hiperparametros_ganador"),
        F.struct(
            F.col("algorithm").alias("Algoritmo"), F.col("r2").alias("R2"), F.col("mae").alias("MAE"),
            F.col("rmse").alias("RMSE"), F.col("mape").alias("MAPE"),
        ).alias("metricas_test"),
    ).join(compared, "sku")


def read_model_report(spark: SparkSession, path: str) -> DataFrame:
    """Report rows from JSON lines, one per SKU."""
    return spark.read.schema(REPORT).json(path)


def report_rows(documents: DataFrame, column: str = "value", group: str = "grupo_1") -> DataFrame:
    """Report rows from nested documents ``{group: {sku: {...}}}`` held as text."""
    nested = F.from_json(column, f"map<string,map<string,{REPORT_ENTRY}>>")
    return documents.select(F.explode(nested[group]).alias("sku", "_r")).select("sku", "_r.*")


def flatten_model_report(report: DataFrame, algorithms: tuple[str, ...] = ("Ridge", "XGBoost", "RandomForest")) -> DataFrame:
    """One flat row per SKU; a MAPE that is not positive is unknown."""
    m, comparison = F.col("metricas_test"), F.col("comparativa")
    return report.select(
        "sku",
        F.coalesce("algoritmo_ganador", F.lit("—")).alias("ganador"),
        F.col("hiperparametros_ganador").alias("hiperparametros"),
        m["R2"].alias("r2"),
        m["MAE"].alias("mae"),
        m["RMSE"].alias("rmse"),
        F.when(m["MAPE"] > 0, m["MAPE"]).alias("mape"),
        *[F.coalesce(comparison[a]["R2_CV"], comparison[a]["R2"]).alias(f"r2_{a}") for a in algorithms],
        *[comparison[a]["MAE"].alias(f"mae_{a}") for a in algorithms],
    )
