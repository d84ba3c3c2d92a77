"""Checked queries: files in and out (A1-A11). Files are written from the tables into the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from demand_engine.functions.expressions import rounded
from demand_engine.operators import cleaning, models, pareto, profiles
from demand_engine.plans.ledger_queries import CUT, TOP
from demand_engine.plans.ledger_views import clean_ledger, movements
from demand_engine.plans.model_queries import METRICS, NAIVE, ROUNDED, naive_best
from demand_engine.plans.planning_queries import forecast_of
from demand_engine.plans.registry import query, sql
from demand_engine.plans.series_queries import brand_weeks
from demand_engine.session import shared_folder
from demand_engine.sources import ledger, tables

LEDGER = "sku, descripcion, fecha, documento, numero, bodega, entrada, salida, cliente, canal, punto"


def fresh(spark, name: str) -> str:
    """A new folder for this run in the folder all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def write_ledger(rows, path: str, header_case=str) -> None:
    """A ledger file of a query: as text it takes several times the tables it is made of, so its parts are compressed (Spark tells by their names)."""
    ledger.write_movements(rows, path, header_case, compression="gzip")


def ledger_files(spark, d, ordered: bool = False) -> str:
    """The ledger as two files with different headers, and a backup that must not be read."""
    folder = fresh(spark, "ledger")
    rows = movements(spark, d, parties=True, names=True)
    early = F.col("fecha") < "1998-01-01"
    first = rows.where(early)
    write_ledger(first.orderBy("orden", "linea") if ordered else first, f"{folder}/Movimientos_1997.csv")
    write_ledger(rows.where(~early), f"{folder}/Movimientos_2001.csv", str.lower)
    write_ledger(rows.where(early), f"{folder}/Movimientos_1997_Backup.csv")
    return folder


# In the second file only the headers with a known lower-case alias keep their values.
READ = """
SELECT sku, CASE WHEN old THEN descripcion END AS descripcion, fecha, documento, numero,
  CASE WHEN old THEN bodega END AS bodega, entrada, salida, CASE WHEN old THEN cliente END AS cliente,
  CASE WHEN old THEN canal END AS canal, CASE WHEN old THEN punto END AS punto,
  CASE WHEN old THEN 'Movimientos_1997.csv' ELSE 'Movimientos_2001.csv' END AS archivo
FROM (SELECT *, fecha < DATE '1998-01-01' AS old FROM mv)"""


@query("a1_read_movements", sql(READ, "mv"))
def a1_read_movements(spark, d):
    read = ledger.read_movements(spark, ledger_files(spark, d))
    return read.select(*LEDGER.split(", "), "archivo")


@query(
    "a2_normalize_headers",
    sql('SELECT sku AS "Código", numero AS "Número", documento AS "Documento", entrada AS "Entrada", salida AS "Salida" FROM mv', "mv"),
)
def a2_normalize_headers(spark, d):
    raw = movements(spark, d).select(
        F.col("sku").alias(" código "), F.col("numero").alias("número"), F.col("documento").alias("Documento"),
        F.col("entrada").alias("entrada "), F.col("salida").alias("salida"),
    )
    return ledger.normalize_headers(raw)


VALIDATED = """
SELECT 'Movimientos_1997.csv' AS file, TRUE AS valid_name, '' AS missing, TRUE AS valid FROM mv WHERE fecha < DATE '1998-01-01' HAVING COUNT(*) > 0
UNION ALL SELECT 'Movimientos_1997_Backup.csv', TRUE, '', TRUE FROM mv WHERE fecha < DATE '1998-01-01' HAVING COUNT(*) > 0
UNION ALL SELECT 'Movimientos_2001.csv', TRUE, '', TRUE FROM mv WHERE fecha >= DATE '1998-01-01' HAVING COUNT(*) > 0
UNION ALL SELECT 'Movimientos_sin_salida.csv', TRUE, 'salida', FALSE FROM mv HAVING COUNT(*) > 0
UNION ALL SELECT 'otros.csv', FALSE, '', FALSE FROM mv HAVING COUNT(*) > 0"""


@query("a4_validate_ingest", sql(f"SELECT * FROM ({VALIDATED})", "mv"))
def a4_validate_ingest(spark, d):
    folder = ledger_files(spark, d)
    rows = movements(spark, d)
    write_ledger(rows.drop("salida"), f"{folder}/Movimientos_sin_salida.csv")
    write_ledger(rows.select("sku", "fecha", "entrada", "salida"), f"{folder}/otros.csv")
    return ledger.validate_ingest(spark, folder).withColumn("missing", F.array_join("missing", ","))


@query(
    "a5_ingest_log",
    sql(
        """SELECT * FROM (SELECT 'Movimientos_1997.csv' AS filename, COUNT(*) AS rows, TRUE AS replaced FROM mv WHERE fecha < DATE '1998-01-01'
UNION ALL SELECT 'Movimientos_1997.csv', COUNT(*), FALSE FROM mv WHERE fecha < DATE '1998-01-01'
UNION ALL SELECT 'Movimientos_1997_Backup.csv', COUNT(*), FALSE FROM mv WHERE fecha < DATE '1998-01-01'
UNION ALL SELECT 'Movimientos_2001.csv', COUNT(*), FALSE FROM mv WHERE fecha >= DATE '1998-01-01')""",
        "mv",
    ),
)
def a5_ingest_log(spark, d):
    counts = ledger.count_rows(spark, ledger_files(spark, d))
    first = counts.where("filename = 'Movimientos_1997.csv'")
    log = ledger.ingest_log(first, None, "2001-12-01 00:00:00")
    return ledger.ingest_log(counts, log, "2001-12-02 00:00:00").drop("fecha")


@query(
    "a6_preview",
    sql(
        """SELECT sku AS codigo, CAST(fecha AS VARCHAR) AS fecha, left(documento, 30) AS doc, CAST(CAST(entrada AS DOUBLE) AS VARCHAR) AS entrada,
  CAST(CAST(salida AS DOUBLE) AS VARCHAR) AS salida FROM mv WHERE fecha < DATE '1998-01-01' ORDER BY orden, linea LIMIT 25""",
        "mv",
    ),
)
def a6_preview(spark, d):
    return ledger.preview(spark, f"{ledger_files(spark, d, ordered=True)}/Movimientos_1997.csv")[0]


@query(
    "a6_preview_summary",
    sql("SELECT COUNT(*) AS total_rows, TRUE AS has_required FROM mv WHERE fecha < DATE '1998-01-01'", "mv"),
)
def a6_preview_summary(spark, d):
    return ledger.preview(spark, f"{ledger_files(spark, d)}/Movimientos_1997.csv")[1]


@query("a7_write_table", sql(TOP.format(source="clean"), "clean", sku="item"))
def a7_write_table(spark, d):
    top = profiles.top_products(clean_ledger(spark, d, sku="item"))
    path = fresh(spark, "table")
    tables.write_table(top, path, "csv")
    return tables.read_table(spark, path, ", ".join(f"{n} {t}" for n, t in top.dtypes))


@query("a8_write_report", sql(CUT, "pareto", sku="item"))
def a8_write_report(spark, d):
    cut = pareto.pareto_cut(pareto.pareto_curve(cleaning.sales(clean_ledger(spark, d, sku="item"))))
    path = fresh(spark, "report")
    tables.write_report(cut, path)
    return spark.read.schema(cut.schema).json(path)


@query("a9_write_per_sku", sql("SELECT * FROM weekly", "weekly"))
def a9_write_per_sku(spark, d):
    series = brand_weeks(spark, d)
    path = fresh(spark, "series")
    tables.write_per_sku(series, path)
    return spark.read.schema(series.schema).parquet(path)


@query("a10_read_forecast_long", sql("SELECT upper(sku) AS sku, h, prediction, lower, upper FROM forecast", "forecast"))
def a10_read_forecast_long(spark, d):
    path = fresh(spark, "forecast")
    tables.write_forecast_long(forecast_of(spark, d), path)
    return tables.read_forecast_long(spark, path)


@query(
    "a11_flatten_model_report",
    sql(
        "SELECT * FROM (SELECT sku, algorithm AS ganador, " + ROUNDED + " FROM winners) JOIN (SELECT sku, "
        + ", ".join(f"round(MAX(r2) FILTER (algorithm = '{a}'), 6) + 0.0 AS r2_{a}" for a in NAIVE)
        + " FROM mean_scores GROUP BY sku) USING (sku)",
        "winners",
        "mean_scores",
    ),
)
def a11_flatten_model_report(spark, d):
    best = naive_best(spark, d)
    path = fresh(spark, "models")
    tables.write_report(tables.model_report(best, models.select_winner(best, NAIVE)), path)
    flat = tables.flatten_model_report(tables.read_model_report(spark, path), NAIVE)
    scores = [*METRICS, *[f"r2_{a}" for a in NAIVE]]
    return rounded(flat, 6, *scores).select("sku", "ganador", *[(F.col(c) + 0.0).alias(c) for c in scores])
