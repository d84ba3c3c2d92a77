import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from demand_engine.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
           "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def ledger(spark):
    """Builds a ledger from dicts; missing fields get plain values."""

    def build(*rows):
        base = {"sku": "P1", "descripcion": "d", "fecha": "2023-01-02", "documento": "Venta", "numero": "1",
                "bodega": "B", "entrada": 0.0, "salida": 0.0, "saldo": 0.0, "cliente": "ACME", "canal": "Tienda",
                "punto": "Local1"}
        full = [{**base, **r} for r in rows]
        schema = ", ".join(f"{k} {'double' if k in ('entrada', 'salida', 'saldo') else 'string'}" for k in base)
        df = spark.createDataFrame([tuple(r[k] for k in base) for r in full], schema)
        return df.withColumn("fecha", df["fecha"].try_cast("date"))

    return build


@pytest.fixture
def series(spark):
    """Builds (sku, week_start, salida) from {sku: [values]} with weeks from 2022-01-03 on; None leaves a gap."""
    import datetime as dt

    def build(values, first=dt.date(2022, 1, 3), column="salida"):
        rows = [
            (sku, first + dt.timedelta(weeks=i), float(v))
            for sku, vs in values.items()
            for i, v in enumerate(vs)
            if v is not None
        ]
        return spark.createDataFrame(rows, f"sku string, week_start date, {column} double")

    return build
