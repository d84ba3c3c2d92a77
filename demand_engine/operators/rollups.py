"""Dashboard roll-ups over the ledger and the weekly series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demand_engine.functions.expressions import beside, half_up, normalize_sku, ratio
from demand_engine.functions.wide import wide

CLIENTS_SHOWN = 15
RISK_PCT = 80.0


def _named(c: str):
    """Trimmed text; blank or missing counts as unknown."""
    text = F.trim(F.col(c))
    return F.when(text.isNull() | (text == ""), "Desconocido").otherwise(text)


def _market_rows(df: DataFrame) -> DataFrame:
    return df.where((F.col("salida") > 0) & (F.trim(F.coalesce("sku", F.lit(""))) != ""))


def channel_by_product(df: DataFrame) -> DataFrame:
    """D10."""
    return (
        _market_rows(df)
        .groupBy("sku", _named("canal").alias("canal"))
        .agg(half_up(F.sum("salida")).alias("ventas"), F.count("*").alias("transacciones"))
    )


def channel_shares(by_channel: DataFrame, selected: DataFrame) -> DataFrame:
    """D11, long: ventas, total and whole percent of every channel a selected SKU sells through."""
    keys = selected.select(normalize_sku("sku").alias("_key")).distinct()
    rows = by_channel.withColumn("sku", normalize_sku("sku"))
    sums = rows.join(keys, rows["sku"] == keys["_key"], "left_semi").groupBy("sku", "canal").agg(F.sum("ventas").alias("ventas"))
    total = F.sum("ventas").over(W.partitionBy("sku"))
    return sums.withColumn("total", total).withColumn("pct", half_up(ratio(F.col("ventas") * 100, F.col("total"), 0.0)))


def channel_mix(by_channel: DataFrame, selected: DataFrame, channels: list[str] | None = None) -> DataFrame:
    """D11, wide: selected SKUs x channels with totals and whole percents, both over all channels.

    ``channels`` lists the columns to show; without it they are the channels there are (an action).
    """
    shares = channel_shares(by_channel, selected)
    if channels is None:
        channels = sorted(r[0] for r in shares.select("canal").distinct().collect())
    shown = {c: F.coalesce(F.max(F.when(F.col("canal") == c, F.col("ventas"))), F.lit(0.0)) for c in channels}
    shown["total"] = F.max("total")
    shown |= {f"{c}_pct": F.coalesce(F.max(F.when(F.col("canal") == c, F.col("pct"))), F.lit(0.0)) for c in channels}
    return shares.groupBy("sku").agg(*[e.alias(c) for c, e in shown.items()])


def top_clients(df: DataFrame, k: int = CLIENTS_SHOWN) -> DataFrame:
    """The k largest clients; the running percent is of these k clients' total."""
    totals = (
        _market_rows(df)
        .groupBy(_named("cliente").alias("cliente"))
        .agg(F.sum("salida").alias("_s"), F.count("*").alias("transacciones"))
        .orderBy(F.desc("_s"), "cliente")
        .limit(k)
        .withColumn("ventas", half_up("_s"))
    )
    ranked = W.orderBy(F.desc("_s"), "cliente")  # k rows
    running = F.sum("ventas").over(ranked.rowsBetween(W.unboundedPreceding, 0))
    every = F.sum("ventas").over(ranked.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return totals.select(
        F.row_number().over(ranked).alias("puesto"), "cliente", "ventas", "transacciones",
        half_up(ratio(running * 100, every, 0.0), 1).alias("acumulado_pct"),
    )


def client_concentration(top: DataFrame) -> DataFrame:
    """Running percent of the first three and five clients, and the risk flag on the latter."""
    at = lambda n: F.max(F.when(F.col("puesto") == n, F.col("acumulado_pct")))
    return top.agg(at(3).alias("top3_pct"), at(5).alias("top5_pct")).withColumn(
        "alta_concentracion", F.coalesce(F.col("top5_pct") >= RISK_PCT, F.lit(False))
    )


def product_summary(weekly: DataFrame) -> DataFrame:
    """D13."""
    sold, made = F.sum("sales"), F.sum("production")
    stock = F.mean(F.when(F.col("closing_stock") > 0, F.col("closing_stock")))
    return weekly.groupBy("sku").agg(
        half_up(sold).alias("total_ventas"),
        half_up(made).alias("total_produccion"),
        F.when(made > 0, half_up(F.try_divide(sold * 100, made), 1)).otherwise(0.0).alias("eficiencia"),
        half_up(made - sold).alias("gap_unidades"),
        F.coalesce(half_up(F.try_divide(sold, stock), 1), F.lit(0.0)).alias("rotacion"),
    )


def yearly_by_product(weekly: DataFrame) -> DataFrame:
    """By year of the week's Monday."""
    return weekly.groupBy("sku", F.year("week_start").alias("anio")).agg(
        half_up(F.sum("sales")).alias("ventas"),
        half_up(F.sum("production")).alias("produccion"),
        half_up(F.sum("production") - F.sum("sales")).alias("gap"),
    )


def yearly_wide(yearly: DataFrame, skus: list[str] | None = None) -> DataFrame:
    """Years x SKUs (all, or those listed), null where a SKU has no such year."""
    return wide(yearly, "anio", "sku", F.max("ventas"), skus)


def overproduction_kpis(yearly: DataFrame) -> DataFrame:
    """D16 per SKU: units of the years with a surplus, and the mean yearly gap in percent of sales."""
    pct = F.when(F.col("ventas") > 0, F.try_divide(F.col("gap") * 100, "ventas")).otherwise(0.0)
    return yearly.groupBy("sku").agg(
        F.sum(F.when(F.col("gap") > 0, F.col("gap")).otherwise(0.0)).alias("sobreproduccion"),
        F.mean(pct).alias("gap_pct_medio"),
    )


def monthly_mean_demand(weekly: DataFrame) -> DataFrame:
    """Mean weekly sales per calendar month, all twelve months, 0 without data."""
    grid = weekly.select("sku").distinct().withColumn("mes", F.explode(F.sequence(F.lit(1), F.lit(12))))
    means = weekly.groupBy("sku", F.month("week_start").alias("mes")).agg(half_up(F.mean("sales")).alias("ventas"))
    return grid.join(means, ["sku", "mes"], "left").fillna(0.0, ["ventas"])


def seasonality_index(monthly: DataFrame) -> DataFrame:
    """Month against the mean of the twelve months, 100 = mean. Input: D17."""
    mean = F.sum("ventas").over(W.partitionBy("sku")) / 12
    return monthly.select("sku", "mes", half_up(ratio(F.col("ventas"), mean, 0.0) * 100).alias("indice"))


def seasonality_wide(index: DataFrame, skus: list[str] | None = None) -> DataFrame:
    """Months x SKUs (all, or those listed)."""
    return wide(index, "mes", "sku", F.max("indice"), skus)


def monthly_lagged(weekly: DataFrame) -> DataFrame:
    """D19 per SKU: production of a month next to the sales of the previous month that has data."""
    months = weekly.groupBy("sku", F.date_format("week_start", "yyyy-MM").alias("mes")).agg(
        half_up(F.sum("production")).alias("produccion"), half_up(F.sum("sales")).alias("_v")
    )
    before = F.lag("_v").over(W.partitionBy("sku").orderBy("mes"))
    return months.select("sku", "mes", "produccion", before.alias("ventas_anterior"))


def global_kpis(weeks: DataFrame, listing: DataFrame, n: int = 7) -> DataFrame:
    """Totals and period of the weekly series, number of listed SKUs and the n largest.

    ``weeks``: F3; ``listing``: E4.
    """
    top = listing.orderBy(F.desc("ventas"), "sku").limit(n)
    names = F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("ventas")).alias("v"), F.col("sku").alias("s")))), lambda x: x["s"]
    )
    totals = weeks.agg(
        F.sum("sales").alias("ventas"), F.sum("production").alias("produccion"),
        F.min("week_start").alias("desde"), F.max("week_start").alias("hasta"),
    )
    return beside(totals, listing.agg(F.count("*").alias("skus")), top.agg(F.array_join(names, ",").alias("principales")))


def product_kpis(forecast: DataFrame, weekly: DataFrame, n: int = 104) -> DataFrame:
    """D21 per SKU: mean forecast, mean production of the last n weeks (0: all), ratio in percent."""
    latest = W.partitionBy("sku").orderBy(F.desc("week_start"))
    recent = weekly.withColumn("_r", F.row_number().over(latest)).where(F.col("_r") <= n) if n else weekly
    made = recent.groupBy("sku").agg(F.mean("production").alias("produccion_media"))
    wanted = forecast.groupBy("sku").agg(F.mean("prediction").alias("demanda_media"))
    return wanted.join(made, "sku", "left").select(
        "sku", "demanda_media", F.coalesce("produccion_media", F.lit(0.0)).alias("produccion_media"),
        F.when(F.col("produccion_media") > 0, F.try_divide(F.col("demanda_media") * 100, "produccion_media"))
        .otherwise(0.0).alias("ratio_pct"),
    )
