"""Work assignments of the production weeks and their progress.

Assignments: one row per week (``semana``) with targets per SKU, the operators with what each is to
make, and the operators' progress. Progress updates: one row per (week, operator).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demand_engine.functions.expressions import half_up

OPERATOR = "struct<id:string,token:string,nombre:string,email:string,asignaciones:map<string,double>>"
PROGRESS = "struct<avances:map<string,double>,notas:string,updated:timestamp>"
ASSIGNMENTS = (
    f"semana string, fecha_inicio date, metas_sku map<string,double>, operarios array<{OPERATOR}>, "
    f"progreso map<string,{PROGRESS}>, created_at timestamp, updated_at timestamp"
)
UPDATES = "semana string, operario_id string, avances map<string,double>, notas string, updated timestamp"


def _key(length: int, *parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)


def _with_ids(operators: Column, week: Column) -> Column:
    """Operators without id or token get one derived from week, place and name (stable on retries)."""

    def fill(o: Column, i: Column) -> Column:
        place = i.cast("string")
        return F.struct(
            F.coalesce(o["id"], _key(8, F.lit("id"), week, place, o["nombre"])).alias("id"),
            F.coalesce(o["token"], _key(16, F.lit("token"), week, place, o["nombre"])).alias("token"),
            o["nombre"].alias("nombre"),
            o["email"].alias("email"),
            o["asignaciones"].alias("asignaciones"),
        )

    return F.transform(operators, fill)


def _latest(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """The last row of each key by ``time`` (null comes first; ties: the larger row as JSON)."""
    values = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*values), F.struct(time, F.to_json(F.struct(*values))))
    return df.groupBy(*keys).agg(last.alias("_l")).select(*keys, "_l.*")


def merge_assignments(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Upsert by week. A new version replaces start, targets and operators; progress and
    creation time stay. ``updates`` has the time of the change in ``updated_at``; of several rows of a
    week the last one counts."""
    c, u = current.alias("c"), _latest(updates, ["semana"], "updated_at").alias("u")
    new = F.col("u.semana").isNotNull()

    def pick(name: str, value: Column) -> Column:
        return F.when(new, value).otherwise(F.col(f"c.{name}")).alias(name)

    operators = F.coalesce(F.col("u.operarios"), F.array().cast(f"array<{OPERATOR}>"))
    targets = F.coalesce(F.col("u.metas_sku"), F.create_map().cast("map<string,double>"))
    return c.join(u, F.col("c.semana") == F.col("u.semana"), "full_outer").select(
        F.coalesce("u.semana", "c.semana").alias("semana"),
        pick("fecha_inicio", F.col("u.fecha_inicio")),
        pick("metas_sku", targets),
        pick("operarios", _with_ids(operators, F.col("u.semana"))),
        F.coalesce("c.progreso", F.create_map().cast(f"map<string,{PROGRESS}>")).alias("progreso"),
        F.coalesce("c.created_at", "u.updated_at").alias("created_at"),
        F.coalesce("u.updated_at", "c.updated_at").alias("updated_at"),
    )


def latest_progress(updates: DataFrame) -> DataFrame:
    """The last report per (week, operator)."""
    return _latest(updates, ["semana", "operario_id"], "updated")


def merge_progress(current: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assignments with the latest progress, rejected updates of unknown weeks).

    A stored entry that is newer than the update stays.
    """
    known = updates.join(current.select("semana"), "semana", "left_semi")
    rejected = updates.join(current.select("semana"), "semana", "left_anti")
    entry = F.struct("operario_id", F.struct(
        F.coalesce("avances", F.create_map().cast("map<string,double>")).alias("avances"),
        F.coalesce("notas", F.lit("")).alias("notas"),
        "updated",
    ))
    new = latest_progress(known).groupBy("semana").agg(
        F.map_from_entries(F.collect_list(entry)).alias("_new"), F.max("updated").alias("_at")
    )
    old = F.coalesce("progreso", F.create_map().cast(f"map<string,{PROGRESS}>"))
    newer = lambda k, v: F.coalesce(v["updated"] > F.col("_new")[k]["updated"], F.lit(False))
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key(F.col("_new"), k) | newer(k, v))
    fresh = F.map_filter("_new", lambda k, v: ~F.map_contains_key(kept, k))
    merged = current.join(new, "semana", "left").withColumns(
        {
            "progreso": F.when(F.col("_new").isNull(), old).otherwise(F.map_concat(kept, fresh)),
            "updated_at": F.greatest("_at", "updated_at"),
        }
    )
    return merged.drop("_new", "_at"), rejected


def week_listing(assignments: DataFrame) -> DataFrame:
    """Z3: newest week first."""
    return assignments.select(
        "semana", "fecha_inicio", F.coalesce(F.size("operarios"), F.lit(0)).alias("n_operarios"), "updated_at"
    ).orderBy(F.desc_nulls_last("fecha_inicio"))


def operators(assignments: DataFrame) -> DataFrame:
    """One row per (week, operator)."""
    return assignments.select(
        "semana", "fecha_inicio", "metas_sku", "progreso", F.explode("operarios").alias("operario")
    )


def assignment_by_token(assignments: DataFrame, token: str) -> DataFrame:
    """Z4."""
    return operators(assignments).where(F.col("operario.token") == token)


def _sum(m: Column) -> Column:
    return F.aggregate(F.map_values(m), F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))


def _percent(done: Column, target: Column) -> Column:
    return F.when(target > 0, half_up(F.try_divide(done * 100, target))).otherwise(0.0)


def progress_rollup(assignments: DataFrame) -> DataFrame:
    """Z5 per (week, operator): target and done over the SKUs the week has targets for, percent."""
    rows = operators(assignments)
    active = F.map_filter("metas_sku", lambda k, v: v > 0)
    done = F.coalesce(F.col("progreso")[F.col("operario.id")]["avances"], F.create_map().cast("map<string,double>"))
    mine = F.coalesce("operario.asignaciones", F.create_map().cast("map<string,double>"))
    totals = rows.select(
        "semana",
        F.col("operario.id").alias("operario_id"),
        _sum(F.map_filter(mine, lambda k, v: F.map_contains_key(active, k))).alias("meta"),
        _sum(F.map_filter(done, lambda k, v: F.map_contains_key(active, k))).alias("avance"),
    )
    return totals.withColumn("pct", _percent(F.col("avance"), F.col("meta")))


def progress_by_sku(assignments: DataFrame) -> DataFrame:
    """Z5 per (week, operator, SKU with a target): percent, at most 100."""
    rows = operators(assignments)
    done = F.col("progreso")[F.col("operario.id")]["avances"]
    return (
        rows.select("semana", F.col("operario.id").alias("operario_id"), "operario", done.alias("_done"),
                    F.explode("metas_sku").alias("sku", "_meta"))
        .where(F.col("_meta") > 0)
        .select(
            "semana", "operario_id", "sku",
            F.coalesce(F.col("operario.asignaciones")[F.col("sku")], F.lit(0.0)).alias("meta"),
            F.coalesce(F.col("_done")[F.col("sku")], F.lit(0.0)).alias("avance"),
        )
        .withColumn("pct", F.least(F.lit(100.0), _percent(F.col("avance"), F.col("meta"))))
    )


def progress_status(pct: Column | str) -> Column:
    """Z6."""
    p = F.col(pct) if isinstance(pct, str) else pct
    return F.when(p >= 80, "En meta").when(p >= 40, "En progreso").when(p > 0, "Rezagado").otherwise("Sin iniciar")


def over_assignment(assignments: DataFrame) -> DataFrame:
    """Z7 per (week, SKU with a target): assigned over all operators against the week's target."""
    targets = assignments.select("semana", F.explode("metas_sku").alias("sku", "meta")).where(F.col("meta") > 0)
    given = (
        operators(assignments)
        .select("semana", F.explode("operario.asignaciones").alias("sku", "asignado"))
        .groupBy("semana", "sku")
        .agg(F.sum("asignado").alias("asignado"))
    )
    return (
        targets.join(given, ["semana", "sku"], "left")
        .fillna(0.0, ["asignado"])
        .withColumn("over", F.col("asignado") > F.col("meta"))
    )
