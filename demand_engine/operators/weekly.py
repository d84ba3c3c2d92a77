"""Weekly series: totals, closing stock, demand and gap filling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demand_engine.functions.expressions import beside, half_up, iso_year, week_start
from demand_engine.operators.cleaning import drop_undated
from demand_engine.session import dealt

DEFAULT_ORDER = ("fecha", "numero", "documento", "entrada", "salida", "saldo")


def _weeks(df: DataFrame) -> DataFrame:
    return drop_undated(df).withColumn("week_start", week_start("fecha"))


def weekly_totals(df: DataFrame) -> DataFrame:
    """F1."""
    return _weeks(df).groupBy("week_start").agg(
        F.sum("salida").alias("sales"), F.sum("entrada").alias("production")
    )


def weekly_by_sku(df: DataFrame, order: tuple[str, ...] | list[str] = DEFAULT_ORDER, sparse: bool = False) -> DataFrame:
    """sales, production and last balance per (SKU, week); ``order``, which starts with the day, decides which is last.

    The order matters within a day only: days are summed up first, combined on the map side, and a ledger that is already
    dealt and sorted by (SKU, day), as one with a running stock is, needs neither a shuffle nor a sort for that. A week's
    balance is then its last day's, found by hash from the days' rows.

    ``sparse`` suits many SKUs with few movements each, and readers that leave the balance alone: nearly every movement is
    a day of its own, so the sums by day would hold all rows several times over. Movements are shuffled once, to all shuffle
    partitions by week of a SKU, and summed up there.
    """
    if order[0] != "fecha":
        raise ValueError("the order of movements has to start with their day")
    if sparse:
        keys = ["sku", "week_start"]
        rows = _weeks(df).where(F.col("sku").isNotNull()).select(*keys, "salida", "entrada", "saldo", F.struct(*order).alias("_order"))
        return dealt(rows, *keys).groupBy(*keys).agg(
            F.sum("salida").alias("sales"), F.sum("entrada").alias("production"), F.max_by("saldo", "_order").alias("closing_stock"))
    days = drop_undated(df).where(F.col("sku").isNotNull()).groupBy("sku", "fecha").agg(
        F.sum("salida").alias("sales"), F.sum("entrada").alias("production"), F.max_by("saldo", F.struct(*order[1:])).alias("closing_stock"))
    return _weeks(days).groupBy("sku", "week_start").agg(
        F.sum("sales").alias("sales"), F.sum("production").alias("production"), F.max_by("closing_stock", "fecha").alias("closing_stock"))


def weekly_closing_stock(df: DataFrame, order=DEFAULT_ORDER, carry_forward: bool = False) -> DataFrame:
    """last balance of each SKU in each week, summed over the SKUs that moved that week.

    ``carry_forward`` also counts SKUs that did not move, at their latest balance.
    """
    by_sku = weekly_by_sku(df, order)
    if carry_forward:
        ends = by_sku.groupBy("sku").agg(F.min("week_start").alias("_first"))
        last = _weeks(df).agg(F.max("week_start").alias("_last"))
        grid = beside(ends, last).select(
            "sku", F.explode(F.expr("sequence(_first, _last, interval 7 days)")).alias("week_start")
        )
        order_by = W.partitionBy("sku").orderBy("week_start").rowsBetween(W.unboundedPreceding, 0)
        by_sku = grid.join(by_sku, ["sku", "week_start"], "left").withColumn(
            "closing_stock", F.last("closing_stock", ignorenulls=True).over(order_by)
        )
    return by_sku.groupBy("week_start").agg(F.sum("closing_stock").alias("closing_stock"))


def weekly_consolidated(df: DataFrame, order=DEFAULT_ORDER) -> DataFrame:
    """F1 and F2 side by side; nulls become 0. Both fuse into one pass over (SKU, week)."""
    return (
        weekly_by_sku(df.fillna({"sku": ""}), order)
        .groupBy("week_start")
        .agg(
            F.sum("sales").alias("sales"),
            F.sum("production").alias("production"),
            F.sum(F.when(F.col("sku") != "", F.col("closing_stock"))).alias("closing_stock"),
        )
        .fillna(0.0)
    )


def weekly_demand(df: DataFrame, usual: tuple[str, ...] = ("cliente", "canal", "punto")) -> DataFrame:
    """demand statistics per (SKU, ISO year, ISO week) and the usual client, channel and point.

    ``usual`` names the columns to take the mode of, each into ``<column>_modo`` (ties: the smallest value). Each movement
    is shuffled once, to its week of its SKU. There movements are sorted by each of those columns in turn and numbered
    among those of their value: the highest number belongs to the mode. So nothing but sorts takes memory, and these
    can spill.
    """
    weeks = _weeks(df).where(F.col("sku").isNotNull())
    keys = ["sku", "week_start"]
    x = F.col("salida")
    stats = {
        "salida": F.sum, "transacciones": F.count, "salida_promedio": F.mean, "salida_std": F.stddev_samp, "salida_min": F.min, "salida_max": F.max,
    }
    calendar = {"iso_year": iso_year("week_start"), "iso_week": F.weekofyear("week_start")}
    if not usual:
        return weeks.groupBy(*keys).agg(*[f(x).alias(c) for c, f in stats.items()]).withColumns(calendar)
    numbered = dealt(weeks.select(*keys, x, *[F.col(c).cast("string").alias(c) for c in usual]), *keys)
    for c in usual:
        numbered = numbered.withColumn(f"_{c}", F.row_number().over(W.partitionBy(*keys, c).orderBy(c)))
    most = [F.min(F.when(F.col(c).isNotNull(), F.struct(-F.col(f"_{c}"), F.col(c).alias("v"))))["v"].alias(f"{c}_modo") for c in usual]
    return numbered.groupBy(*keys).agg(*[f(x).alias(c) for c, f in stats.items()], *most).withColumns(calendar).fillna(
        "Unknown", [f"{c}_modo" for c in usual]).select(*keys, *stats, *calendar, *[f"{c}_modo" for c in usual])


NUMERIC = ("transacciones", "salida_promedio", "salida_std", "salida_min", "salida_max")
MODES = ("cliente_modo", "canal_modo", "punto_modo")


def densify_weeks(weekly: DataFrame, min_weeks: int = 2) -> DataFrame:
    """every Monday between a SKU's first and last week; SKUs with fewer weeks are dropped.

    Each observed week emits itself and the weeks up to the next observed one, so no calendar join
    is needed. Columns stay null in the added weeks; ``is_imputed`` marks them. The observed
    neighbours stay available to F7 and F8 as ``_from`` (left) and ``_to`` (right), ``_step`` weeks
    after the left one out of ``_gap``.
    """
    series = W.partitionBy("sku").orderBy("week_start")
    whole = series.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    values = [c for c in weekly.columns if c not in ("sku", "week_start", "iso_year", "iso_week")]
    spans = (
        weekly.withColumns(
            {
                "_n": F.count("*").over(whole),
                "_next": F.lead("week_start").over(series),
                "_to": F.lead("salida").over(series),
            }
        )
        .where(F.col("_n") >= min_weeks)
        .withColumn("_gap", F.coalesce(F.datediff("_next", "week_start") / 7, F.lit(1)).cast("int"))
    )
    dense = spans.select(
        "sku",
        F.col("week_start").alias("_start"),
        F.struct(*values).alias("_from"),
        "_to",
        "_gap",
        F.explode(F.sequence(F.lit(0), F.col("_gap") - 1)).alias("_step"),
    ).withColumn("week_start", F.date_add("_start", F.col("_step") * 7))
    observed = F.col("_step") == 0
    return dense.select(
        "sku",
        "week_start",
        iso_year("week_start").alias("iso_year"),
        F.weekofyear("week_start").alias("iso_week"),
        *[F.when(observed, F.col("_from")[c]).alias(c) for c in values],
        (~observed).alias("is_imputed"),
        "_from",
        "_to",
        "_gap",
        "_step",
    )


def interpolate_linear(dense: DataFrame) -> DataFrame:
    """demand of the added weeks on the straight line between the observed ones, at least 0."""
    left = F.col("_from")["salida"]
    line = left + (F.col("_to") - left) / F.col("_gap") * F.col("_step")
    value = F.when(F.col("is_imputed"), line).otherwise(F.col("salida"))
    return dense.withColumn("salida", F.coalesce(F.greatest(value, F.lit(0.0)), F.lit(0.0)))


def ffill_categories(dense: DataFrame, columns: tuple[str, ...] = MODES) -> DataFrame:
    """F8: added weeks take the last observed mode, else 'Unknown'."""
    present = [c for c in columns if c in dense.columns]
    return dense.withColumns({c: F.coalesce(c, F.col("_from")[c], F.lit("Unknown")) for c in present})


def zero_fill_numeric(dense: DataFrame, columns: tuple[str, ...] = NUMERIC) -> DataFrame:
    """F9."""
    return dense.fillna(0, list(columns))


def weekly_dense(weekly: DataFrame, interpolated: bool = True) -> DataFrame:
    """F5 -> F6..F9. ``interpolated=False`` leaves the added weeks at zero demand."""
    dense = densify_weeks(weekly)
    dense = interpolate_linear(dense) if interpolated else dense.fillna(0.0, ["salida"])
    return zero_fill_numeric(ffill_categories(dense)).drop("_from", "_to", "_gap", "_step")


def backtest_series(weekly: DataFrame) -> DataFrame:
    """totals, number of weeks and mean weekly sales per SKU (whole units)."""
    return weekly.groupBy("sku").agg(
        half_up(F.sum("production")).alias("produccion_total"),
        half_up(F.sum("sales")).alias("ventas_total"),
        F.count("*").alias("n_semanas"),
        half_up(F.sum("sales") / F.count("*")).alias("avg_semanal"),
    )


def timeline(weekly: DataFrame) -> DataFrame:
    """sales and production per week over all SKUs of the series (whole units)."""
    return weekly.groupBy("week_start").agg(
        half_up(F.sum("sales")).alias("ventas"), half_up(F.sum("production")).alias("produccion")
    )


def monthly_timeline(weeks: DataFrame) -> DataFrame:
    """the F10 timeline by month of the week's Monday."""
    return weeks.groupBy(F.date_format("week_start", "yyyy-MM").alias("mes")).agg(
        F.sum("ventas").alias("ventas"), F.sum("produccion").alias("produccion")
    )
