"""Time-series features per SKU on the dense weekly series.

All windows partition by SKU and order by week: one exchange and one sort serve every feature. The
expressions are SQL text, which keeps a table of a hundred features quick to plan.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAGS = (1, 2, 3, 4, 13, 52)
AVERAGES = (2, 4, 8, 13, 26)
VOLATILITIES = (4, 8, 13)
TRENDS = (4, 8)
SPANS = (4, 13)
EWMA_BLOCK = 256

X = "salida"
SERIES = "PARTITION BY sku ORDER BY week_start"
PAST = f"{SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
EARLIER = f"{SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
WHOLE = f"{SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"


def _previous(weeks: int) -> str:
    return f"{SERIES} ROWS BETWEEN {weeks} PRECEDING AND 1 PRECEDING"


def _with(df: DataFrame, expressions: dict[str, str]) -> DataFrame:
    """Adds columns, or replaces those of the same name, given as SQL text."""
    kept = [f"`{c}`" if c not in expressions else f"{expressions[c]} AS `{c}`" for c in df.columns]
    added = [f"{e} AS `{c}`" for c, e in expressions.items() if c not in df.columns]
    return df.selectExpr(*kept, *added)


_CALENDAR = {
    "mes": "month(week_start)",
    "trimestre": "quarter(week_start)",
    "dia_semana": "weekday(week_start)",
    "dia_anio": "dayofyear(week_start)",
    "num_semana_anio": "weekofyear(week_start)",
}


def calendar_features(df: DataFrame) -> DataFrame:
    """G1."""
    return _with(df, _CALENDAR)


def _lags(offsets=LAGS) -> dict[str, str]:
    return {f"lag_{n}": f"lag({X}, {n}) OVER ({SERIES})" for n in offsets}


def lags(df: DataFrame, offsets: tuple[int, ...] = LAGS) -> DataFrame:
    """G2."""
    return _with(df, _lags(offsets))


def _averages(windows=AVERAGES) -> dict[str, str]:
    return {f"ma_{w}": f"avg({X}) OVER ({_previous(w)})" for w in windows}


def moving_average(df: DataFrame, windows: tuple[int, ...] = AVERAGES) -> DataFrame:
    """Mean of the previous w weeks, fewer at the start, null in the first week."""
    return _with(df, _averages(windows))


def _anomaly(drop: float = 0.70) -> dict[str, str]:
    return {"anomalia_binaria": f"int(coalesce({X} > 0 AND ma_4 > 0 AND {X} < {drop}D * ma_4, false))"}


def anomaly_flag(df: DataFrame, drop: float = 0.70) -> DataFrame:
    """Demand more than 30 % below its recent mean."""
    return _with(df, _anomaly(drop))


def _volatilities(windows=VOLATILITIES) -> dict[str, str]:
    return {f"volatilidad_{w}": f"coalesce(stddev_samp({X}) OVER ({_previous(w)}), 0D)" for w in windows}


def volatility(df: DataFrame, windows: tuple[int, ...] = VOLATILITIES) -> DataFrame:
    """G5."""
    return _with(df, _volatilities(windows))


def _trends(windows=TRENDS) -> dict[str, str]:
    return {f"trend_vs_ma{w}": f"coalesce(try_divide({X} - ma_{w}, ma_{w}), 0D)" for w in windows}


def trend_vs_ma(df: DataFrame, windows: tuple[int, ...] = TRENDS) -> DataFrame:
    """Relative distance to the moving average; 0 where that average is 0 or missing."""
    return _with(df, _trends(windows))


_POSITION = {"trend_lineal": f"double(row_number() OVER ({SERIES}) - 1)"}


def linear_trend(df: DataFrame) -> DataFrame:
    """0-based position in the series."""
    return _with(df, _POSITION)


def ewma(df: DataFrame, spans: tuple[int, ...] = SPANS) -> DataFrame:
    """e_t = (1-a) e_{t-1} + a x_{t-1}, a = 2/(span+1), started at the first value.

    Needs ``trend_lineal`` (G8) and ``lag_1`` (G2). The recursion is written as a running sum of
    x_j (1-a)^-j inside blocks of 256 weeks (so powers stay in range); the values at the ends of all
    blocks before are folded into what is carried over. A span of 1 is the value before.
    """
    at = f"(trend_lineal % {EWMA_BLOCK})"
    block = f"PARTITION BY sku, floor(trend_lineal / {EWMA_BLOCK}) ORDER BY week_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    sums, states = {}, {}
    for span in spans:
        if span == 1:
            states["ewma_1"] = "if(trend_lineal > 0, lag_1, null)"
            continue
        a = 2.0 / (span + 1)
        keep = f"{1.0 - a!r}D"
        # Week 1 sees the first value in full.
        scaled = f"lag_1 * if(trend_lineal = 1, 1D, {a!r}D) * pow({keep}, -{at})"
        sums[f"_in_{span}"] = f"coalesce(sum({scaled}) OVER ({block}) * pow({keep}, {at}), 0D)"
        ends = f"collect_list(if({at} = {EWMA_BLOCK - 1}, _in_{span}, null)) OVER ({EARLIER})"
        passed = f"aggregate({ends}, 0D, (carried, x) -> carried * pow({keep}, {EWMA_BLOCK}) + x)"
        states[f"ewma_{span}"] = f"if(trend_lineal > 0, _in_{span} + {passed} * pow({keep}, {at} + 1), null)"
    return _with(_with(df, sums), states).drop(*sums)


_RUN_STARTS = {
    "_pos": f"row_number() OVER ({SERIES})",
    "_start": f"if(({X} > 0) <=> (lag({X} > 0) OVER ({SERIES})), null, row_number() OVER ({SERIES}))",
}
_RUN_POSITION = {"semanas_desde_ultima_venta": f"_pos - last(_start, true) OVER ({PAST})"}


def run_position(df: DataFrame) -> DataFrame:
    """0-based position inside the current run of weeks with, or without, demand."""
    return _with(_with(df, _RUN_STARTS), _RUN_POSITION).drop(*_RUN_STARTS)


_YOY = {
    "yoy_ratio": f"greatest(0D, least(5D, coalesce(try_divide(lag({X}, 1) OVER ({SERIES}), lag({X}, 52) OVER ({SERIES})), 1D)))"
}


def yoy_ratio(df: DataFrame) -> DataFrame:
    """Previous week against the same week last year; 1 where unknown, within [0, 5]."""
    return _with(df, _YOY)


def _per(numerator: str, denominator: str) -> str:
    return f"{numerator} / if({denominator} = 0, 1D, {denominator})"


_INTRA = {
    "ratio_min_max": _per("salida_min", "salida_max"),
    "variabilidad_intra": _per("salida_std", "salida_promedio"),
}


def intra_week_ratios(df: DataFrame) -> DataFrame:
    """G11."""
    return _with(df, _INTRA)


_TRANSACTIONS = {
    "ratio_transacciones": "try_divide(transacciones, avg(transacciones) OVER "
    f"({SERIES} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))"
}


def ratio_transactions(df: DataFrame) -> DataFrame:
    """Transactions against their mean over this and the three weeks before."""
    return _with(df, _TRANSACTIONS)


_WEEK_ANGLE = f"({2 * math.pi!r}D * num_semana_anio / 52)"
_MONTH_ANGLE = f"({2 * math.pi!r}D * (mes - 1) / 12)"
_CYCLES = {
    "semana_sin": f"sin{_WEEK_ANGLE}",
    "semana_cos": f"cos{_WEEK_ANGLE}",
    "mes_sin": f"sin{_MONTH_ANGLE}",
    "mes_cos": f"cos{_MONTH_ANGLE}",
}


def cyclic_encoding(df: DataFrame) -> DataFrame:
    """G13."""
    return _with(df, _CYCLES)


CALENDAR = (*_CALENDAR, *_CYCLES)  # features that the week alone determines

ONE_HOT = {"cliente_modo": "empresa", "canal_modo": "canal", "punto_modo": "punto", "trimestre": "trim"}


def one_hot_long(df: DataFrame, columns: dict[str, str] = ONE_HOT) -> DataFrame:
    """G14, sparse: one row per (SKU, week, indicator that is 1). Suits any number of categories."""
    named = [F.concat(F.lit(prefix + "_"), F.col(c).cast("string")) for c, prefix in columns.items()]
    return df.select("sku", "week_start", F.explode(F.array(*named)).alias("feature"), F.lit(1).alias("value"))


def categories(df: DataFrame, column: str) -> list:
    """The distinct values of a column, for the wide ``one_hot``: for columns of few values such as the quarter."""
    return sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().collect())


def _indicators(values: dict[str, list], columns: dict[str, str] = ONE_HOT) -> dict[str, str]:
    out = {}
    for c, listed in values.items():
        for v in listed:
            text = str(v).replace("\\", "\\\\").replace("'", "\\'")
            hit = f"int({c} = '{text}')"
            out[f"{columns[c]}_{v}"] = f"if(max({hit}) OVER ({WHOLE}) = 1, {hit}, null)"
    return out


def one_hot(df: DataFrame, values: dict[str, list], columns: dict[str, str] = ONE_HOT) -> DataFrame:
    """G14, wide: one 0/1 column per category of ``values`` (column -> categories).

    A category a SKU never has is null for that SKU, as the indicators are made per SKU.
    """
    return _with(df, _indicators(values, columns))


_CUMULATIVE = {"semana_consecutivas_venta": f"sum(int({X} > 0)) OVER ({PAST})"}


def cumulative_sale_weeks(df: DataFrame) -> DataFrame:
    """Running number of weeks with demand."""
    return _with(df, _CUMULATIVE)


IMPUTED = tuple(
    [f"lag_{n}" for n in LAGS]
    + [f"ma_{w}" for w in AVERAGES]
    + [f"volatilidad_{w}" for w in VOLATILITIES]
    + [f"ewma_{s}" for s in SPANS]
)


def impute_lags(df: DataFrame, columns: tuple[str, ...] = IMPUTED, backfill: bool = True) -> DataFrame:
    """Forward, then backward fill within the SKU, then 0. ``backfill=False`` uses no later week."""
    forward = f"last({{c}}, true) OVER ({PAST})"
    # After the forward fill only weeks before the first known value are open.
    backward = f"first({{c}}, true) OVER ({WHOLE}), " if backfill else ""
    filled = f"coalesce({{c}}, {forward}, {backward}0D)"
    return _with(df, {c: filled.format(c=c) for c in columns})


# Features that look at the current week's own demand: excluded from models by ``leak_safe``.
LEAKING = ("anomalia_binaria", "trend_vs_ma4", "trend_vs_ma8", "semanas_desde_ultima_venta", "semana_consecutivas_venta",
           "ratio_min_max", "ratio_transacciones", "variabilidad_intra")
# What a feature tells: the past of the series, or its place in time. Indicators (G14) tell what is planned ahead.
PAST_ROLE, TIME_ROLE, AHEAD_ROLE = "pasado", "temporal", "futuro"
SMOOTHED = {**{f"ma_{w}": w for w in AVERAGES}, **{f"ewma_{s}": s for s in SPANS}}
ROLES = {
    **dict.fromkeys([f"lag_{n}" for n in LAGS] + [*SMOOTHED, "trend_lineal"], PAST_ROLE),
    **dict.fromkeys([f"volatilidad_{w}" for w in VOLATILITIES] + [f"trend_vs_ma{w}" for w in TRENDS], PAST_ROLE),
    **dict.fromkeys([*_INTRA, *_TRANSACTIONS], PAST_ROLE),
    **dict.fromkeys([*_CALENDAR, *_CYCLES, *_CUMULATIVE], TIME_ROLE),
}


def role(name: str) -> str | None:
    """Role of a feature: as declared, or ahead for an indicator of one of the ``ONE_HOT`` columns; else none."""
    if name in ROLES:
        return ROLES[name]
    return AHEAD_ROLE if name.split("_")[0] in ONE_HOT.values() and "_" in name else None


KEYS = ("sku", "week_start", "iso_year", "iso_week", "salida")
NOT_FEATURES = (*KEYS, "transacciones", "salida_promedio", "salida_std", "salida_min", "salida_max",
                "cliente_modo", "canal_modo", "punto_modo", "is_imputed")


def build_features(
    dense: DataFrame,
    one_hot_values: dict[str, list] | None = None,
    impute: bool = True,
    backfill: bool = True,
) -> DataFrame:
    """All features. ``one_hot_values``: categories per column for the wide G14.

    The independent windows are declared together, so they run as one window operator.
    """
    first = {
        **_CALENDAR, **_lags(), **_averages(), **_volatilities(), **_RUN_STARTS, **_POSITION, **_YOY, **_TRANSACTIONS,
        **_CUMULATIVE,
    }
    if one_hot_values:
        quarter = {"trimestre"} & set(one_hot_values)
        first |= _indicators({c: v for c, v in one_hot_values.items() if c not in quarter})
    df = ewma(_with(dense, first))
    if one_hot_values and quarter:
        df = one_hot(df, {"trimestre": one_hot_values["trimestre"]})
    derived = {**_RUN_POSITION, **_anomaly(), **_trends(), **_INTRA, **_CYCLES}
    df = _with(df, derived).drop(*_RUN_STARTS)
    return impute_lags(df, backfill=backfill) if impute else df


def feature_columns(df: DataFrame, leak_safe: bool = False) -> list[str]:
    skip = set(NOT_FEATURES) | (set(LEAKING) if leak_safe else set())
    return [c for c in df.columns if c not in skip]
