"""The whole computation from a ledger to a production plan."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demand_engine.operators import (
    cleaning,
    demand_class,
    features,
    forecast,
    materials,
    models,
    outliers,
    pareto,
    planning,
    profiles,
    rollups,
    selection,
    weekly,
)
from demand_engine.session import shared_folder


class Run:
    """Named results. Hub tables with several consumers are written to a folder all executors share
    and read back: that cuts the lineage, survives lost executors and gives later plans real sizes.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{shared_folder(spark)}/run-{uuid.uuid4().hex[:12]}"
        self.tables: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        self.tables[name] = self.spark.read.schema(df.schema).parquet(path)
        return self.tables[name]


def analyse(ledger: DataFrame, order=weekly.DEFAULT_ORDER, run: Run | None = None) -> Run:
    """Cleaning, profiles and weekly series of a ledger (``sources.ledger.read_movements``)."""
    run = run or Run(ledger.sparkSession)
    clean = run.keep("clean", cleaning.clean_movements(ledger, cleaning.GUIDES_LONG))
    sold, stock = profiles.sales_by_product(clean, list(order)), profiles.stock_by_product(clean)
    by_sku = run.keep("weekly_by_sku", weekly.weekly_by_sku(cleaning.with_normalized_sku(clean), order))
    run.tables |= {
        "sales_by_product": sold,
        "production_by_product": profiles.production_by_product(clean, list(order)),
        "stock_by_product": stock,
        "inventory_rotation": profiles.inventory_rotation(sold, stock),
        "sales_by_warehouse": profiles.sales_by_warehouse(clean),
        "sales_by_channel": profiles.sales_by_channel(clean),
        "monthly_trend": profiles.monthly_trend(clean),
        "run_summary": profiles.run_summary(clean),
        "weekly": weekly.weekly_consolidated(clean, order),
        "product_summary": rollups.product_summary(by_sku),
        "backtest": weekly.backtest_series(by_sku),
    }
    return run


def analyse_sheets(run: Run, config: DataFrame | None = None) -> Run:
    """Sheet consumption and costs on top of ``analyse``."""
    by_sku = run["weekly_by_sku"]
    config = config or materials.sheets_per_unit(by_sku.sparkSession)
    consumption = materials.sheet_consumption(by_sku, config)
    summary = materials.sheet_cost_summary(by_sku, config)
    run.tables |= {
        "sheet_consumption": consumption,
        "sheet_gap": materials.sheet_gap(consumption),
        "sheet_weekly_total": materials.sheet_weekly_total(consumption),
        "sheet_cost_summary": summary,
        "sheet_totals": materials.sheet_totals(summary),
    }
    return run


def prepare(ledger: DataFrame, top: int = 20, run: Run | None = None) -> Run:
    """Modelling data: cap, best sellers, outliers, Pareto, weekly series, features, classes.

    Demand is classed on the series with empty weeks at zero; features use the interpolated one.
    """
    run = run or Run(ledger.sparkSession)
    kept = cleaning.exclude_balanced_guides(cleaning.exclude_transfers(ledger), cleaning.GUIDES_SHORT)
    capped = run.keep("capped", outliers.cap_p99(kept))
    best = run.keep("top_products", profiles.top_products(capped, top))
    replaced = run.keep("best_sellers", outliers.replace_iqr_outliers(profiles.restrict_to(cleaning.sales(capped), best)))
    curve = run.keep("pareto", pareto.pareto_curve(replaced))
    demand = run.keep("weekly_demand", weekly.weekly_demand(cleaning.critical_only(replaced, curve.where("in_80"))))
    classes = demand_class.classify_demand(demand_class.adi_cv2(weekly.weekly_dense(demand, interpolated=False)))
    classes = run.keep("demand_class", classes)
    run.tables |= {
        "cleaning_summary": outliers.cleaning_summary(ledger, capped, best),
        "outlier_report": outliers.outlier_report(replaced),
        "pareto_summary": pareto.pareto_summary(curve),
        "channel_by_product": rollups.channel_by_product(replaced),
        "top_clients": rollups.top_clients(replaced),
        "cluster_summary": demand_class.cluster_summary(classes),
    }
    return run


def build_model_table(run: Run, one_hot: tuple[str, ...] = ("trimestre",)) -> Run:
    """Feature table and its selection; ``indicators`` has the sparse form of all categories, however many.

    ``one_hot`` names the columns that also get a table column per category (an action looks them up).
    """
    dense = run.keep("weekly_dense", weekly.weekly_dense(run["weekly_demand"]))
    with_quarter = features.calendar_features(dense)
    run.tables["indicators"] = features.one_hot_long(with_quarter)
    values = {c: features.categories(with_quarter, c) for c in one_hot}
    table = run.keep("features", features.build_features(dense, values))
    matrix, factors = run.keep("correlation", selection.correlation_matrix(table)), run.keep("vif", selection.vif(table))
    run.tables |= {
        "target_correlation": selection.target_correlation(table),
        "indicator_target": selection.indicator_target(run.tables["indicators"], table),
        "selection_summary": selection.selection_summary(table, matrix, factors),
        **{f"features_{k}": v for k, v in selection.select_sets(table, factors).items()},
    }
    return run


def model_and_plan(
    run: Run,
    grid: dict | None = None,
    groups: tuple[str, ...] = (demand_class.GROUP_1,),
    leak_safe: bool = True,
    safety_weeks: float = planning.SAFETY_WEEKS,
) -> Run:
    """Model search, forecast and production plan for the SKUs of the given demand groups."""
    chosen = run["demand_class"].where(F.col("grupo").isin(*groups))
    table = cleaning.critical_only(run["features"], chosen)
    columns = features.feature_columns(table, leak_safe)
    categories = tuple(c for c in weekly.MODES if c in table.columns)
    best, winners = models.search(table, columns, grid, lambda df: run.keep("model_scores", df), categories)
    winners = run.keep("winners", winners)
    fitted = run.keep("fitted", forecast.fit_final(table, winners, columns, categories=categories))
    points = run.keep("forecast", forecast.recursive_forecast(table, winners, fitted, columns))
    run.tables |= {
        "model_comparison": models.model_comparison(best),
        "winner_tally": models.winner_tally(winners),
        "seasonal_index": forecast.seasonal_index(table),
        "forecast_metadata": forecast.forecast_metadata(winners, fitted),
    }
    if "weekly_by_sku" in run.tables:
        normal = points.withColumn("sku", cleaning.normalize_sku("sku"))
        plan = run.keep("plan", planning.production_plan(normal, run["weekly_by_sku"], safety_weeks))
        run.tables |= {
            "plan_header": planning.plan_header(normal, run["weekly_by_sku"], safety_weeks),
            "plan_kpis": planning.plan_kpis(plan),
            "production_weeks": planning.production_weeks(plan),
        }
    return run


def run_all(ledger: DataFrame, grid: dict | None = None, **kw) -> Run:
    run = analyse_sheets(analyse(ledger))
    return model_and_plan(build_model_table(prepare(ledger, run=run)), grid, **kw)
