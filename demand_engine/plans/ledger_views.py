"""The movement ledger as a view over the order tables, once for Spark and once as SQL text.

Lines returned 'A' are receipts, 'N' are sales, 'R' are guides (open) or transfers (filled). Only the
joins a query needs are made: brand and name come from ``part``, client and channel from ``orders``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demand_engine.operators import cleaning

# Columns that put the movements of a SKU into their total order.
ORDER = ["fecha", "orden", "linea", "parte", "proveedor", "importe"]


# Known schemas spare every query the job that looks into the file footers.
SCHEMAS = {
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
    "o_orderpriority string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def movements(
    spark: SparkSession,
    sf_dir: str,
    sku: str = "brand",
    parties: bool = False,
    names: bool = False,
) -> DataFrame:
    """``sku``: 'brand' (few, dense SKUs) or 'item' (many, sparse). ``parties`` adds channel, client
    and point of sale, ``names`` the description."""
    line = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part")
    flag, status, qty = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_quantity")
    guide = (flag == "R") & (status == "O")
    transfer = (flag == "R") & (status == "F")
    if sku == "brand" or names:
        line = line.join(part, line["l_partkey"] == part["p_partkey"])
    df = line.select(
        (F.col("p_brand") if sku == "brand" else F.col("l_partkey").cast("string")).alias("sku"),
        *([F.col("p_name").alias("descripcion")] if names else []),
        F.col("l_shipdate").cast("date").alias("fecha"),
        F.when(flag == "N", "Venta - Boleta")
        .when(flag == "A", "Ingreso - Produccion")
        .when(guide, "Guía de remisión - R001")
        .otherwise("Traspaso entre Almacenes")
        .alias("documento"),
        F.col("l_orderkey").cast("string").alias("numero"),
        F.when(F.col("l_suppkey") % 10 != 9, F.concat(F.lit("B"), F.col("l_suppkey") % 3)).alias("bodega"),
        F.when((flag == "A") | transfer | (guide & (F.col("l_linenumber") <= 4)), qty).otherwise(0.0).alias("entrada"),
        F.when(flag == "A", 0.0).otherwise(qty).alias("salida"),
        F.col("l_orderkey").alias("orden"),
        F.col("l_linenumber").alias("linea"),
        F.col("l_partkey").alias("parte"),
        F.col("l_suppkey").alias("proveedor"),
        F.col("l_extendedprice").alias("importe"),
    )
    if parties:
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
        customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
        nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
        buyers = (
            orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
            .join(nation, customer["c_nationkey"] == nation["n_nationkey"])
            .select(
                F.col("o_orderkey").alias("orden"),
                F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "Online")
                .otherwise("Presencial")
                .alias("canal"),
                F.col("c_name").alias("cliente"),
                F.col("n_name").alias("punto"),
            )
        )
        df = df.join(buyers, "orden")
    return df


def clean_ledger(spark: SparkSession, sf_dir: str, balance: bool = False, **kw) -> DataFrame:
    """The cleaned ledger. The running stock counts every movement, so with ``balance`` the rows to
    leave are marked before it is computed and dropped after."""
    ledger = movements(spark, sf_dir, **kw)
    if not balance:
        return cleaning.clean_movements(ledger)
    marked = cleaning.mark_balanced_guides(cleaning.fill_dimension_defaults(ledger))
    kept = with_balance(marked, ledger).where(~F.col("balanced")).drop("balanced")
    return cleaning.exclude_transfers(kept)


def with_balance(df: DataFrame, movements: DataFrame) -> DataFrame:
    """Running stock per SKU in total order, as opening balance of the day plus the day's movements.

    ``movements`` are the same rows, without anything added to them: their daily totals need no more
    than a scan.

    The long running sum is taken over daily totals; movements are ordered only within (SKU, day),
    so one SKU with a third of all rows is spread over its days. A day's opening balance comes as one
    more row before its movements instead of a join: rows are sorted once, and where nothing asks for
    the balance Spark leaves out the whole of it. Movements without a day count before all days; they leave,
    as those without SKU do.
    """
    net = F.col("entrada") - F.col("salida")
    daily = movements.where(F.col("sku").isNotNull()).groupBy("sku", "fecha").agg(F.sum(net).alias("_net"))
    days = W.partitionBy("sku").orderBy("fecha").rowsBetween(W.unboundedPreceding, -1)
    opening = daily.select(
        "sku", "fecha", F.coalesce(F.sum("_net").over(days), F.lit(0.0)).alias("_opening"), F.lit(False).alias("_moves")
    ).where(F.col("fecha").isNotNull())
    day = W.partitionBy("sku", "fecha").orderBy("_moves", *ORDER[1:]).rowsBetween(W.unboundedPreceding, 0)
    return (
        df.where(F.col("sku").isNotNull() & F.col("fecha").isNotNull())
        .withColumn("_moves", F.lit(True))
        .unionByName(opening, allowMissingColumns=True)
        .withColumn("saldo", F.first("_opening").over(day) + F.sum(net).over(day))
        .where("_moves")
        .select("sku", "fecha", *[c for c in df.columns if c not in ("sku", "fecha")], "saldo")
    )


def movements_sql(sku: str = "brand") -> str:
    """The same ledger as one SELECT."""
    code = "p_brand" if sku == "brand" else "CAST(l_partkey AS VARCHAR)"
    return f"""
SELECT *, SUM(entrada - salida) OVER (PARTITION BY sku ORDER BY fecha, orden, linea, parte, proveedor, importe
       ROWS UNBOUNDED PRECEDING) AS saldo
FROM (
  SELECT {code} AS sku, p_name AS descripcion, CAST(l_shipdate AS DATE) AS fecha,
    CASE WHEN l_returnflag = 'N' THEN 'Venta - Boleta'
         WHEN l_returnflag = 'A' THEN 'Ingreso - Produccion'
         WHEN l_linestatus = 'O' THEN 'Guía de remisión - R001'
         ELSE 'Traspaso entre Almacenes' END AS documento,
    CAST(l_orderkey AS VARCHAR) AS numero,
    CASE WHEN l_suppkey % 10 <> 9 THEN 'B' || CAST(l_suppkey % 3 AS VARCHAR) END AS bodega,
    CASE WHEN l_returnflag = 'A' OR (l_returnflag = 'R' AND (l_linestatus = 'F' OR l_linenumber <= 4))
         THEN l_quantity ELSE 0.0 END AS entrada,
    CASE WHEN l_returnflag = 'A' THEN 0.0 ELSE l_quantity END AS salida,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Online' ELSE 'Presencial' END AS canal,
    c_name AS cliente, n_name AS punto,
    l_orderkey AS orden, l_linenumber AS linea, l_partkey AS parte, l_suppkey AS proveedor,
    l_extendedprice AS importe
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
