"""Checked queries: assignments and progress (Z1-Z7), derived from the order lines.

A week's targets are the quantities shipped per brand; suppliers map to a fixed staff of seven
operators, who are assigned open lines and report filled ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demand_engine.functions.expressions import week_start
from demand_engine.operators import tasks
from demand_engine.plans.ledger_views import table
from demand_engine.plans.registry import part, query, sql

part(
    "work",
    (),
    """
SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS fecha_inicio, 'op' || CAST(l_suppkey % 7 AS VARCHAR) AS operario,
  p_brand AS sku, SUM(CASE WHEN l_linenumber <= 6 THEN l_quantity ELSE 0.0 END) AS meta,
  SUM(CASE WHEN l_returnflag <> 'A' THEN l_quantity ELSE 0.0 END) AS asignado,
  SUM(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0.0 END) AS avance
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
)
part(
    "week_target",
    ("work",),
    "SELECT fecha_inicio, sku, SUM(meta) AS meta FROM work GROUP BY ALL HAVING SUM(meta) > 0",
)
part(
    "active",
    ("work", "week_target"),
    """
SELECT CAST(s.fecha_inicio AS VARCHAR) AS semana, s.operario AS operario_id, sku, COALESCE(w.asignado, 0.0) AS meta, COALESCE(w.avance, 0.0) AS avance
FROM (SELECT DISTINCT fecha_inicio, operario FROM work) s LEFT JOIN week_target t USING (fecha_inicio) LEFT JOIN work w USING (fecha_inicio, operario, sku)""",
)


def work(spark, d) -> DataFrame:
    """Per (week, operator, brand): week target, assigned and done."""
    line, parts = table(spark, d, "lineitem"), table(spark, d, "part").select("p_partkey", "p_brand")
    qty = F.col("l_quantity")
    return (
        line.join(parts, line["l_partkey"] == parts["p_partkey"])
        .groupBy(
            week_start(F.col("l_shipdate").cast("date")).alias("fecha_inicio"),
            F.concat(F.lit("op"), F.col("l_suppkey") % 7).alias("operario"),
            F.col("p_brand").alias("sku"),
        )
        .agg(
            F.sum(F.when(F.col("l_linenumber") <= 6, qty).otherwise(0.0)).alias("meta"),
            F.sum(F.when(F.col("l_returnflag") != "A", qty).otherwise(0.0)).alias("asignado"),
            F.sum(F.when(F.col("l_linestatus") == "F", qty).otherwise(0.0)).alias("avance"),
        )
    )


def assignments(spark, d, changed: str = "1999-01-01") -> DataFrame:
    """Nested assignments, one row per week, without progress. A week has at most 7 operators and
    25 brands, so its arrays and maps are small."""
    rows = work(spark, d)
    mine = rows.groupBy("fecha_inicio", "operario").agg(
        F.map_from_entries(F.collect_list(F.struct("sku", "asignado"))).alias("asignaciones")
    )
    person = F.struct(
        F.col("operario").alias("id"), F.concat("operario", F.lit("-"), F.col("fecha_inicio").cast("string")).alias("token"),
        F.col("operario").alias("nombre"), F.lit(None).cast("string").alias("email"), "asignaciones",
    )
    staff = mine.groupBy("fecha_inicio").agg(F.collect_list(person).alias("operarios"))
    targets = rows.groupBy("fecha_inicio", "sku").agg(F.sum("meta").alias("meta"))
    targets = targets.groupBy("fecha_inicio").agg(F.map_from_entries(F.collect_list(F.struct("sku", "meta"))).alias("metas_sku"))
    return staff.join(targets, "fecha_inicio").select(
        F.col("fecha_inicio").cast("string").alias("semana"), "fecha_inicio", "metas_sku", "operarios",
        F.create_map().cast(f"map<string,{tasks.PROGRESS}>").alias("progreso"),
        F.lit(f"{changed} 08:00:00").cast("timestamp").alias("created_at"),
        F.lit(f"{changed} 08:00:00").cast("timestamp").alias("updated_at"),
    )


def reports(spark, d) -> DataFrame:
    """Progress updates: an empty early report and the full later one per (week, operator)."""
    full = work(spark, d).groupBy("fecha_inicio", "operario").agg(
        F.map_from_entries(F.collect_list(F.struct("sku", "avance"))).alias("avances")
    ).select(F.col("fecha_inicio").cast("string").alias("semana"), F.col("operario").alias("operario_id"), "avances")
    late = full.withColumns({"notas": F.lit("final"), "updated": F.lit("2002-02-02 10:00:00").cast("timestamp")})
    early = full.withColumns({"avances": F.create_map().cast("map<string,double>"), "notas": F.lit("inicio"),
                              "updated": F.lit("2002-02-01 10:00:00").cast("timestamp")})
    return late.unionByName(early)


def tracked(spark, d) -> DataFrame:
    return tasks.merge_progress(assignments(spark, d), reports(spark, d))[0]


@query(
    "z1_merge_assignments",
    sql(
        """SELECT CAST(fecha_inicio AS VARCHAR) AS semana, fecha_inicio, COUNT(DISTINCT operario) AS n_operarios, SUM(meta) AS meta,
  SUM(asignado) AS asignado, MAX(CASE WHEN fecha_inicio < DATE '2000-01-01' THEN 1999 ELSE 2001 END) AS creado,
  MAX(CASE WHEN fecha_inicio < DATE '1998-01-01' THEN 1999 ELSE 2001 END) AS cambiado FROM work GROUP BY ALL""",
        "work",
    ),
)
def z1_merge_assignments(spark, d):
    # The stored version holds the weeks before 2000 and half the targets; the new one those from 1998 on.
    stored = assignments(spark, d).where("fecha_inicio < '2000-01-01'")
    halved = F.transform_values("metas_sku", lambda k, v: F.when(F.col("fecha_inicio") >= "1998-01-01", v / 2).otherwise(v))
    new = assignments(spark, d, "2001-01-01").where("fecha_inicio >= '1998-01-01'")
    merged = tasks.merge_assignments(stored.withColumn("metas_sku", halved), new)
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda a, v: a + v)
    given = F.aggregate("operarios", F.lit(0.0), lambda a, o: a + total(o["asignaciones"]))
    return merged.select(
        "semana", "fecha_inicio", F.size("operarios").cast("long").alias("n_operarios"), total("metas_sku").alias("meta"),
        given.alias("asignado"), F.year("created_at").alias("creado"), F.year("updated_at").alias("cambiado"),
    )


@query(
    "z2_merge_progress",
    sql(
        """SELECT CAST(fecha_inicio AS VARCHAR) AS semana, operario AS operario_id, SUM(avance) AS avance, 'final' AS notas
FROM work WHERE fecha_inicio >= DATE '1998-01-01' GROUP BY ALL""",
        "work",
    ),
)
def z2_merge_progress(spark, d):
    known = assignments(spark, d).where("fecha_inicio >= '1998-01-01'")
    merged, _ = tasks.merge_progress(known, reports(spark, d))
    rows = merged.select("semana", F.explode("progreso").alias("operario_id", "p"))
    done = F.aggregate(F.map_values("p.avances"), F.lit(0.0), lambda a, v: a + v)
    return rows.select("semana", "operario_id", done.alias("avance"), F.col("p.notas").alias("notas"))


@query(
    "z2_rejected_progress",
    sql(
        """SELECT CAST(fecha_inicio AS VARCHAR) AS semana, operario AS operario_id, notas
FROM (SELECT DISTINCT fecha_inicio, operario FROM work WHERE fecha_inicio < DATE '1998-01-01')
CROSS JOIN (VALUES ('final'), ('inicio')) t(notas)""",
        "work",
    ),
)
def z2_rejected_progress(spark, d):
    known = assignments(spark, d).where("fecha_inicio >= '1998-01-01'")
    return tasks.merge_progress(known, reports(spark, d))[1].select("semana", "operario_id", "notas")


@query(
    "z3_week_listing",
    sql(
        """SELECT CAST(fecha_inicio AS VARCHAR) AS semana, fecha_inicio, CAST(COUNT(DISTINCT operario) AS INTEGER) AS n_operarios
FROM work GROUP BY ALL""",
        "work",
    ),
)
def z3_week_listing(spark, d):
    return tasks.week_listing(assignments(spark, d)).drop("updated_at")


@query(
    "z4_assignment_by_token",
    sql(
        """SELECT CAST(fecha_inicio AS VARCHAR) AS semana, operario, sku, asignado FROM work
WHERE operario = 'op3' AND fecha_inicio = DATE '1998-03-02'""",
        "work",
    ),
)
def z4_assignment_by_token(spark, d):
    found = tasks.assignment_by_token(assignments(spark, d), "op3-1998-03-02")
    return found.select("semana", F.col("operario.id").alias("operario"), F.explode("operario.asignaciones").alias("sku", "asignado"))


PCT = "CASE WHEN SUM(meta) > 0 THEN floor(SUM(avance) * 100 / SUM(meta) + 0.5) ELSE 0.0 END"
part(
    "rollup_rows",
    ("active",),
    f"SELECT semana, operario_id, SUM(meta) AS meta, SUM(avance) AS avance, {PCT} AS pct FROM active GROUP BY semana, operario_id",
)


@query("z5_progress_rollup", sql("SELECT * FROM rollup_rows", "rollup_rows"))
def z5_progress_rollup(spark, d):
    return tasks.progress_rollup(tracked(spark, d))


@query(
    "z5_progress_by_sku",
    sql(
        """SELECT semana, operario_id, sku, meta, avance,
  least(100.0, CASE WHEN meta > 0 THEN floor(avance * 100 / meta + 0.5) ELSE 0.0 END) AS pct FROM active WHERE sku IS NOT NULL""",
        "active",
    ),
)
def z5_progress_by_sku(spark, d):
    return tasks.progress_by_sku(tracked(spark, d))


@query(
    "z6_progress_status",
    sql(
        """SELECT semana, operario_id, pct, CASE WHEN pct >= 80 THEN 'En meta' WHEN pct >= 40 THEN 'En progreso'
  WHEN pct > 0 THEN 'Rezagado' ELSE 'Sin iniciar' END AS estado FROM rollup_rows""",
        "rollup_rows",
    ),
)
def z6_progress_status(spark, d):
    rows = tasks.progress_rollup(tracked(spark, d))
    return rows.select("semana", "operario_id", "pct", tasks.progress_status("pct").alias("estado"))


@query(
    "z7_over_assignment",
    sql(
        """SELECT CAST(fecha_inicio AS VARCHAR) AS semana, sku, SUM(meta) AS meta, SUM(asignado) AS asignado, SUM(asignado) > SUM(meta) AS over
FROM work GROUP BY ALL HAVING SUM(meta) > 0""",
        "work",
    ),
)
def z7_over_assignment(spark, d):
    return tasks.over_assignment(assignments(spark, d))
