"""Registry of the checked queries: the Spark plan of an operator next to its independent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from demand_engine.plans.ledger_views import movements_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Named parts of the SQL side. "{mv}" stands for the ledger at the wanted SKU level.
PARTS: dict[str, str] = {
    "mv": "{mv}",
    "filled": """
SELECT * REPLACE (COALESCE(bodega, 'Sin asignar') AS bodega, COALESCE(documento, 'Desconocido') AS documento,
                  COALESCE(canal, 'Sin canal') AS canal, COALESCE(cliente, 'Sin cliente') AS cliente) FROM mv""",
    "moved": """
SELECT *, lower(documento) LIKE '%guía de remisión - r%' AS es_guia FROM filled
WHERE NOT lower(documento) LIKE '%traspaso entre almac%'""",
    "balanced": """
SELECT numero FROM moved WHERE es_guia GROUP BY numero HAVING round(SUM(entrada), 6) = round(SUM(salida), 6)""",
    "clean": """
SELECT * EXCLUDE (es_guia) FROM moved WHERE NOT (es_guia AND numero IN (SELECT numero FROM balanced))""",
    "sold": "SELECT * FROM clean WHERE salida > 0",
    "made": "SELECT * FROM clean WHERE entrada > 0",
    "weekly": """
SELECT sku, CAST(date_trunc('week', fecha) AS DATE) AS week_start, SUM(salida) AS sales, SUM(entrada) AS production,
       arg_max(saldo, row(fecha, orden, linea, parte, proveedor, importe)) AS closing_stock
FROM clean GROUP BY ALL""",
    "totals": "SELECT sku, SUM(salida) AS total FROM sold GROUP BY sku",
    "curve": """
SELECT sku, row_number() OVER w AS rank, total,
       SUM(total) OVER (w ROWS UNBOUNDED PRECEDING) * 100.0 / SUM(total) OVER () AS cum_pct
FROM totals WINDOW w AS (ORDER BY total DESC, sku)""",
    "pareto": "SELECT *, cum_pct <= 80 OR rank = 1 AS in_80, cum_pct <= 90 OR rank = 1 AS in_90 FROM curve",
}
NEEDS: dict[str, tuple[str, ...]] = {
    "mv": (),
    "filled": ("mv",),
    "moved": ("filled",),
    "balanced": ("moved",),
    "clean": ("moved", "balanced"),
    "sold": ("clean",),
    "made": ("clean",),
    "weekly": ("clean",),
    "totals": ("sold",),
    "curve": ("totals",),
    "pareto": ("curve",),
}


def part(name: str, needs: tuple[str, ...], sql: str) -> None:
    """Add a named part to the SQL side."""
    PARTS[name] = sql
    NEEDS[name] = needs


def sql(body: str, *needs: str, sku: str = "brand") -> str:
    """``body`` preceded by the parts it needs, in order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for n in NEEDS[name]:
                visit(n)
            ordered.append(name)

    for n in needs:
        visit(n)
    text = ",\n".join(f"{n} AS {_hint(n)}({PARTS[n].strip()})" for n in ordered)
    code = "p_brand" if sku == "brand" else "CAST(p_partkey AS VARCHAR)"
    text = text.replace("{mv}", movements_sql(sku).strip()).replace("{code}", code)
    body = body.strip()
    glue = "" if body.startswith(",") else "\n"
    start = "WITH RECURSIVE" if any(_recursive(n) for n in ordered) else "WITH"
    return f"{start} {text}{glue}{body}" if ordered else body


def _recursive(name: str) -> bool:
    return f"FROM {name} " in PARTS[name]


def _hint(name: str) -> str:
    return "" if _recursive(name) else "MATERIALIZED "


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with its SQL where SQL can express it."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register
