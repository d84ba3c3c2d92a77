"""Column contracts shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

# Ledger column -> header used in the CSV files (fixed values of the file format).
LEDGER_HEADERS = {
    "sku": "Código",
    "descripcion": "Descripción",
    "fecha": "Fecha",
    "documento": "Documento",
    "numero": "Número",
    "bodega": "Bodega",
    "entrada": "Entrada",
    "salida": "Salida",
    "saldo": "Saldo",
    "valor_unitario": "Valor Unitario",
    "entrada_valor": "Entrada.1",
    "salida_valor": "Salida.1",
    "saldo_valor": "Saldo.1",
    "costo_unitario": "Costo Unitario",
    "cliente": "Empresa_Cliente",
    "canal": "Canal_Venta",
    "punto": "Punto_Venta",
}

QUANTITIES = ("entrada", "salida", "saldo")
MONEY = ("valor_unitario", "entrada_valor", "salida_valor", "saldo_valor", "costo_unitario")

MOVEMENTS = T.StructType(
    [
        T.StructField(
            name,
            T.DoubleType() if name in QUANTITIES + MONEY else T.DateType() if name == "fecha" else T.StringType(),
        )
        for name in LEDGER_HEADERS
    ]
)

WEEKLY = T.StructType(
    [
        T.StructField("sku", T.StringType()),
        T.StructField("week_start", T.DateType()),
        T.StructField("sales", T.DoubleType()),
        T.StructField("production", T.DoubleType()),
        T.StructField("closing_stock", T.DoubleType()),
    ]
)

FORECAST = T.StructType(
    [
        T.StructField("sku", T.StringType()),
        T.StructField("h", T.IntegerType()),
        T.StructField("week_start", T.DateType()),
        T.StructField("prediction", T.DoubleType()),
        T.StructField("lower", T.DoubleType()),
        T.StructField("upper", T.DoubleType()),
    ]
)
