"""Queries over the test tables, one or more for each operator, and their SQL for DuckDB.

``hourly``, ``daily`` and ``panel`` derive the engine's kinds of series from events and orders, over
whole tables. Values are rounded in both engines, since sums of doubles depend on order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import features as X
from .models import LinearModel, automl_leaderboard, feature_importance, train_model
from .models.explain import cv_score, pdp
from .operators import events as E
from .operators import joins as J
from .operators import lags as L
from .operators import metrics as M
from .operators import panel as P
from .operators import prepare as R
from .operators import scm as S
from .plans import decompose as D
from .plans import normalise as N
from .sources import stations, trajectory

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL where SQL can express it."""

    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _round(c, digits: int):
    """Rounded off the grid: finite decimals that lie on a tie would round differently in the two engines."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1.23e-9, digits)


# Base series -------------------------------------------------------------------------------------------


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A test table, its zone-less times as timestamps."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema.fields if f.dataType.simpleString() == "timestamp_ntz"})


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy(F.date_trunc("hour", "ts").alias("date")).agg(_round(F.avg("value"), 6).alias("value"), F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").cast("double").alias("errors"))


HOURLY = "hourly as (select date_trunc('hour', ts) as date, round(1.23e-9 + avg(value), 6) as value, count(*) as n, cast(count(*) filter (where event_type = 'error') as double) as errors from events group by 1)"


def daily(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(_round(F.avg("o_totalprice") / 1000, 6).alias("value"), F.count("*").alias("n"))
    li = table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("d")).agg(_round(F.avg("l_quantity"), 6).alias("quantity"), _round(F.avg("l_discount") * 100, 6).alias("discount"), _round(F.avg("l_tax") * 100, 6).alias("tax"))
    return o.join(li, "d").select(F.col("d").cast("timestamp").alias("date"), "value", F.col("n").cast("double").alias("n"), "quantity", "discount", "tax")


DAILY = (
    "daily as (select cast(o.d as timestamp) as date, o.value, cast(o.n as double) as n, l.quantity, l.discount, l.tax from "
    "(select cast(o_orderdate as date) as d, round(1.23e-9 + avg(o_totalprice) / 1000, 6) as value, count(*) as n from orders group by 1) o join "
    "(select cast(l_shipdate as date) as d, round(1.23e-9 + avg(l_quantity), 6) as quantity, round(1.23e-9 + avg(l_discount) * 100, 6) as discount, round(1.23e-9 + avg(l_tax) * 100, 6) as tax from lineitem group by 1) l on o.d = l.d)"
)


def monthly(spark: SparkSession, sf: str) -> DataFrame:
    """The panel: month x nation, mean order price in thousands."""
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    x = table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return x.groupBy(F.trunc(F.to_date("o_orderdate"), "month").alias("date"), F.col("n_name").alias("unit")).agg(_round(F.avg("o_totalprice") / 1000, 6).alias("outcome"))


MONTHLY = "monthly as (select cast(date_trunc('month', o_orderdate) as date) as date, n_name as unit, round(1.23e-9 + avg(o_totalprice) / 1000, 6) as outcome from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2)"
CUTOFF, LAST = "1999-01-01", "2001-12-31"


def complete(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    """The complete panel of well covered units, and the treated unit."""
    m = monthly(spark, sf).persist()
    t = m.agg(F.min("unit")).first()[0]
    return P.prepare_panel(m, "date", "unit", "outcome", CUTOFF, t, min_coverage=0.65, freq="M").data, t


GRID = (
    MONTHLY + ", grid as (select d.date, u.unit, m.outcome from (select cast(unnest(generate_series((select min(date) from monthly), (select max(date) from monthly), interval 1 month)) as date) as date) d "
    "cross join (select distinct unit from monthly) u left join monthly m on m.date = d.date and m.unit = u.unit), "
    f"cov as (select unit, avg(case when date < date '{CUTOFF}' then case when outcome is not null then 1.0 else 0.0 end end) as pre, avg(case when date >= date '{CUTOFF}' then case when outcome is not null then 1.0 else 0.0 end end) as post from grid group by 1)"
)
FULL = (
    GRID + ", numbered as (select g.*, row_number() over (partition by unit order by date) as i from grid g where unit in (select unit from cov where pre >= 0.65 and post >= 0.65 union select min(unit) from monthly)), "
    "marks as (select *, last_value(case when outcome is not null then i end ignore nulls) over a as pi, last_value(outcome ignore nulls) over a as pv, first_value(case when outcome is not null then i end ignore nulls) over b as ni, first_value(outcome ignore nulls) over b as nv from numbered "
    "window a as (partition by unit order by date rows between unbounded preceding and current row), b as (partition by unit order by date rows between current row and unbounded following)), "
    "full_panel as (select date, unit, coalesce(outcome, pv + (nv - pv) * (i - pi) / nullif(ni - pi, 0), pv, nv) as outcome from marks)"
)


def seconds(c: str) -> str:
    return f"cast(epoch({c}) as bigint)"


# Preparation --------------------------------------------------------------------------------------------


@query("prepare_hourly", f"with {HOURLY} select strftime(date, '%Y-%m-%d %H') as date, value, {seconds('date')} as date_unix, cast(dayofyear(date) as int) as day_julian, cast(isodow(date) - 1 as int) as weekday, cast(hour(date) as int) as hour from hourly")
def _(spark, sf):
    x = R.add_date_variables(R.check_data(R.process_date(hourly(spark, sf)), "value", []))
    return x.select(F.date_format("date", "yyyy-MM-dd HH").alias("date"), "value", F.col("date_unix").cast("long").alias("date_unix"), "day_julian", "weekday", "hour")


@query("process_date_text", "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as date from events")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy/MM/dd HH:mm:ss").alias("when"), F.col("event_type").alias("kind"))
    return R.process_date(e).select("event_id", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"))


@query(
    "impute_median_mode",
    "with x as (select event_id, case when event_id % 17 = 0 then null else value end as value, case when event_id % 13 = 0 then null else event_type end as kind from events), "
    "m as (select quantile_cont(value, 0.5) as v from x), k as (select kind from x where kind is not null group by 1 order by count(*) desc, min(event_id) limit 1) "
    "select event_id, round(1.23e-9 + coalesce(x.value, m.v), 6) as value, coalesce(x.kind, k.kind) as kind from x, m, k",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    x = e.select("event_id", F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 13 != 0, F.col("event_type")).alias("kind"))
    return R.impute(x, order=["event_id"]).select("event_id", _round("value", 6).alias("value"), "kind")


@query("impute_dropna", "select event_id, round(1.23e-9 + value, 6) as value from events where event_id % 17 <> 0")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 17 != 0, _round("value", 6)).alias("value"))
    return R.impute(e, dropna=True)


_NUMBERED = f"with {DAILY}, r as (select date, row_number() over (order by date) - 1 as i, count(*) over () as n from daily)"


@query("split_ts", _NUMBERED + " select cast(date as date) as date, case when i < cast(floor(n * 0.75) as bigint) then 'training' else 'testing' end as set from r")
def _(spark, sf):
    return R.split_sets(daily(spark, sf), "ts").select(F.to_date("date").alias("date"), "set")


@query("split_random", _NUMBERED + f", h as (select date, n, i, {R.portable_sql('i', '0', 5)} as h from r), k as (select date, n, row_number() over (order by h, i) - 1 as k from h) select cast(date as date) as date, case when k < cast(floor(n * 0.75) as bigint) then 'training' else 'testing' end as set from k")
def _(spark, sf):
    return R.split_sets(daily(spark, sf), "random", seed=5).select(F.to_date("date").alias("date"), "set")


def _block_sql(group: str) -> str:
    return (
        f"with {DAILY}, g as (select date, {group} as g from daily), r as (select date, g, row_number() over (partition by g order by date) - 1 as r, count(*) over (partition by g) as n from g), "
        f"s as (select date, r, n, cast(floor(n * 0.75) as bigint) as cut, {R.portable_sql('g', '1', 3)} as h from r) "
        "select cast(date as date) as date, case when r >= h % (cut + 1) and r < h % (cut + 1) + n - cut then 'testing' else 'training' end as set from s"
    )


@query("split_month_block", _block_sql("cast(year(date) * 100 + month(date) as bigint)"))
def _(spark, sf):
    return R.split_sets(daily(spark, sf), "month_ts", seed=3).select(F.to_date("date").alias("date"), "set")


@query("split_season_block", _block_sql("cast((year(date) + case when month(date) = 12 then 1 else 0 end) * 100 + (month(date) % 12) // 3 as bigint)"))
def _(spark, sf):
    return R.split_sets(daily(spark, sf), "season_ts", seed=3).select(F.to_date("date").alias("date"), "set")


@query("conditional_pool", f"with {DAILY} select cast(date as date) as date, quantity from daily where month(date) in (6, 7, 8) and quantity > 20")
def _(spark, sf):
    x = daily(spark, sf).withColumn("m", F.month("date"))
    return R.conditional_filter(x, {"m": [6, 7, 8], "quantity": lambda c: c > 20}).select(F.to_date("date").alias("date"), "quantity")


# Features ---------------------------------------------------------------------------------------------------


@query("lag_features", f"with {HOURLY} select strftime(date, '%Y-%m-%d %H') as date, value, lag(value, 1) over w as value_lag1, lag(value, 6) over w as value_lag6, lead(value, 2) over w as ahead from hourly window w as (order by date)")
def _(spark, sf):
    x = X.shift(X.add_lags(hourly(spark, sf), ["value"], [1, 6]), "value", -2, "ahead")
    return x.select(F.date_format("date", "yyyy-MM-dd HH").alias("date"), "value", "value_lag1", "value_lag6", "ahead")


def _rolling_sql(frame: str, w: int) -> str:
    c = f"case when count(value) over f >= {w} then round"
    return f"with {HOURLY} select strftime(date, '%Y-%m-%d %H') as date, {c}(1.23e-9 + avg(value) over f, 5) end as value_roll{w}_mean, {c}(1.23e-9 + stddev_samp(value) over f, 5) end as value_roll{w}_sd, {c}(1.23e-9 + min(value) over f, 5) end as value_roll{w}_min, {c}(1.23e-9 + max(value) over f, 5) end as value_roll{w}_max, {c}(1.23e-9 + sum(value) over f, 4) end as value_roll{w}_sum, {c}(1.23e-9 + quantile_cont(value, 0.5) over f, 5) end as value_roll{w}_median from hourly window f as (order by date rows between {frame})"


def _rolled(df: DataFrame, w: int, causal: bool) -> DataFrame:
    x = X.add_rolling(df, ["value"], [w], ["mean", "sd", "min", "max", "sum", "median"], causal=causal)
    return x.select(F.date_format("date", "yyyy-MM-dd HH").alias("date"), *(_round(f"value_roll{w}_{a}", 4 if a == "sum" else 5).alias(f"value_roll{w}_{a}") for a in ("mean", "sd", "min", "max", "sum", "median")))


@query("rolling_causal", _rolling_sql("5 preceding and current row", 6))
def _(spark, sf):
    return _rolled(hourly(spark, sf), 6, True)


@query("rolling_centered", _rolling_sql("2 preceding and 2 following", 5))
def _(spark, sf):
    return _rolled(hourly(spark, sf), 5, False)


@query("rolling_grouped", "select event_id, lag(value, 2) over w as value_lag2, case when count(value) over (partition by user_id order by event_id rows between 3 preceding and current row) >= 2 then round(1.23e-9 + avg(value) over (partition by user_id order by event_id rows between 3 preceding and current row), 5) end as value_roll4_mean from events window w as (partition by user_id order by event_id)")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "value")
    x = X.add_rolling(X.add_lags(e, ["value"], [2], "user_id", "event_id"), ["value"], [4], ["mean"], 2, "user_id", "event_id")
    return x.select("event_id", "value_lag2", _round("value_roll4_mean", 5).alias("value_roll4_mean"))


@query("cyclical", "select event_id, round(1.23e-9 + sin(2 * pi() * hour(ts) / 24), 6) + 0.0 as hour_sin, round(1.23e-9 + cos(2 * pi() * hour(ts) / 24), 6) + 0.0 as hour_cos from events")
def _(spark, sf):
    x = X.cyclical_encode(table(spark, sf, "events").select("event_id", F.hour("ts").alias("hour")), "hour", 24, drop=True)
    return x.select("event_id", *((_round(c, 6) + 0.0).alias(c) for c in ("hour_sin", "hour_cos")))


@query("wind_uv", "select event_id, round(1.23e-9 + -value * sin(radians((event_id * 37) % 360)), 5) + 0.0 as u, round(1.23e-9 + -value * cos(radians((event_id * 37) % 360)), 5) + 0.0 as v from events")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value", (F.col("event_id") * 37 % 360).alias("wd"))
    return X.wind_to_uv(e, "value", "wd").select("event_id", *((_round(c, 5) + 0.0).alias(c) for c in ("u", "v")))


@query("resample_mean_week", f"with {DAILY} select cast(date_trunc('week', date + interval 1 day) - interval 1 day as date) as date, round(1.23e-9 + avg(value), 4) as value, round(1.23e-9 + avg(quantity), 4) as quantity from daily group by 1")
def _(spark, sf):
    return M.resample_mean(daily(spark, sf).select("date", "value", "quantity"), "W").select(F.to_date("date").alias("date"), _round("value", 4).alias("value"), _round("quantity", 4).alias("quantity"))


# Metrics --------------------------------------------------------------------------------------------------------


def _stats_sql(groups: str, by: str) -> str:
    """Scores of 0.5 * errors + 100 against value, in hourly."""
    keys = f"{by}, " if by else ""
    eq = f"using ({by})" if by else "on true"
    group = f"group by {by}" if by else ""
    return (
        f"with {HOURLY}, b as (select {groups} 100 + 5 * errors as m, value as o from hourly), a as (select {keys} avg(o) as mo from b {group}), "
        f"j as (select b.*, m - o as d, abs(o - mo) as s from b join a {eq}) "
        f"select {keys} count(*) as n, round(1.23e-9 + avg(case when m / (o + 1e-9) between 0.5 and 2 then 1.0 else 0.0 end), 5) as \"FAC2\", round(1.23e-9 + avg(d), 4) as \"MB\", round(1.23e-9 + avg(abs(d)), 4) as \"MGE\", round(1.23e-9 + sum(d) / nullif(sum(o), 0), 5) as \"NMB\", round(1.23e-9 + sum(abs(d)) / nullif(sum(o), 0), 5) as \"NMGE\", round(1.23e-9 + sqrt(avg(d * d)), 4) as \"RMSE\", "
        "round(1.23e-9 + case when count(*) > 1 and stddev_samp(m) > 0 and stddev_samp(o) > 0 then corr(m, o) end, 4) + 0.0 as r, round(1.23e-9 + 1 - sum(abs(d)) / nullif(sum(s), 0), 4) as \"COE\", "
        "round(1.23e-9 + case when sum(s) = 0 and sum(abs(d)) = 0 then 1.0 when sum(abs(d)) <= 2 * sum(s) then 1 - sum(abs(d)) / nullif(2 * sum(s), 0) else 2 * sum(s) / nullif(sum(abs(d)), 0) - 1 end, 4) as \"IOA\" "
        f"from j {group}"
    )


_DIGITS = {"FAC2": 5, "MB": 4, "MGE": 4, "NMB": 5, "NMGE": 5, "RMSE": 4, "COE": 4, "IOA": 4}


def _scored(spark, sf, by: list[str], include_all: bool = False) -> DataFrame:
    x = hourly(spark, sf).withColumn("prediction", 100 + 5 * F.col("errors"))
    s = M.stats(x, "prediction", "value", by, include_all=include_all)
    return s.select(*by, "n", *(_round(c, d).alias(c) for c, d in _DIGITS.items()), (_round("r", 4) + 0.0).alias("r"))


@query("stats_global", _stats_sql("", ""))
def _(spark, sf):
    return _scored(spark, sf, [])


@query("stats_by_hour", _stats_sql("cast(cast(hour(date) as int) as varchar) as hour,", "hour"))
def _(spark, sf):
    return _scored(spark, sf, ["hour"])


@query("stats_by_season_weekday", _stats_sql("case when month(date) in (12, 1, 2) then 'DJF' when month(date) in (3, 4, 5) then 'MAM' when month(date) in (6, 7, 8) then 'JJA' else 'SON' end as season, cast(isodow(date) - 1 as varchar) as weekday,", "season, weekday"))
def _(spark, sf):
    return _scored(spark, sf, ["season", "weekday"])


@query("stats_p_level")
def _(spark, sf):
    return M.stats(hourly(spark, sf), "errors", "value", ["weekday"], include_all=True)


@query(
    "polar_bins",
    "with x as (select value as x, value as ws, cast((event_id * 37) % 360 as double) as wd from events), t as (select quantile_cont(ws, 0.99) as top from x), "
    "b as (select x, top, greatest(cast(ceil(ws / (top / 8)) as int), 1) as i, greatest(cast(ceil(wd / 10.0) as int), 1) as k from x, t where ws <= top) "
    "select (k - 0.5) * 10.0 as theta, round(1.23e-9 + (i - 0.5) * any_value(top) / 8, 5) as r, round(1.23e-9 + avg(x), 5) as statistic, count(*) as n from b group by i, k",
)
def _(spark, sf):
    e = table(spark, sf, "events").select("value", (F.col("event_id") * 37 % 360).cast("double").alias("wd"))
    return M.polar_bins(e, "value", "value", "wd").select("theta", _round("r", 5).alias("r"), _round("statistic", 5).alias("statistic"), "n")


@query(
    "cv_folds",
    f"with {DAILY}, r as (select date, row_number() over (order by date) - 1 as i, count(*) over () as n from daily), f as (select unnest(range(1, 6)) as fold), "
    "e as (select f.fold, r.date, r.i, r.n - (5 - f.fold) * greatest(1, r.n // 6) as hi, r.n - (6 - f.fold) * greatest(1, r.n // 6) as lo from r, f) "
    "select cast(fold as int) as fold, case when i < lo - 2 then 'train' else 'test' end as role, cast(date as date) as date from e where i < lo - 2 or (i >= lo and i < hi)",
)
def _(spark, sf):
    return M.time_series_cv(daily(spark, sf), 5, gap=2).select("fold", "role", F.to_date("date").alias("date"))


@query(
    "cv_score_linear",
    f"with {DAILY}, r as (select date, value, quantity, row_number() over (order by date) - 1 as i, count(*) over () as n from daily), f as (select unnest(range(1, 4)) as fold), "
    "e as (select f.fold, r.*, r.n - (3 - f.fold) * greatest(1, r.n // 4) as hi, r.n - (4 - f.fold) * greatest(1, r.n // 4) as lo from r, f), "
    "m as (select fold, regr_slope(value, quantity) as b, regr_intercept(value, quantity) as a, count(*) as n_train from e where i < lo group by 1) "
    "select cast(fold as int) as fold, n_train, count(*) as n_test, round(1.23e-9 + sqrt(avg(power(a + b * quantity - value, 2))), 3) as \"RMSE\", round(1.23e-9 + avg(a + b * quantity - value), 3) as \"MB\" from e join m using (fold) where i >= lo and i < hi group by 1, 2",
)
def _(spark, sf):
    s = cv_score(daily(spark, sf), "value", ["quantity"], "linear", 3)
    return s.select("fold", "n_train", "n_test", _round("RMSE", 3).alias("RMSE"), _round("MB", 3).alias("MB"))


# Normalisation ------------------------------------------------------------------------------------------------------

MODEL = LinearModel(20.0, {"quantity": 1.5, "discount": -2.0, "date_unix": 1e-8, "weekday": 0.25})
_BASE = "base as (select date, value, quantity, discount, epoch(date) as du, cast(isodow(date) - 1 as double) as wk, row_number() over (order by date, value) - 1 as i from daily)"
_POOL = "pool as (select quantity as pq, discount as pd, row_number() over (order by date, quantity, discount) - 1 as k, count(*) over () as m from daily)"
_PRED = "20.0 + 1.5 * pq - 2.0 * pd + 1e-8 * du + 0.25 * wk"


def _normal_sql(n: int, seed: int, pool: str = _POOL, agg: str = "") -> str:
    idx = R.portable_sql("b.i", "s.s", seed)
    return f"with {DAILY}, {_BASE}, {pool}, s as (select unnest(range({n})) as s), d as (select b.*, s.s, (({idx}) * (select max(m) from pool)) >> 31 as k from base b, s), x as (select d.*, pool.* exclude (k, m), {_PRED} as p from d join pool using (k)) {agg or 'select cast(date as date) as date, round(1.23e-9 + avg(value), 4) as observed, round(1.23e-9 + avg(p), 4) as normalised from x group by 1'}"


def _rounded(df: DataFrame, names: list[str], digits: int = 4) -> DataFrame:
    return df.select(F.to_date("date").alias("date"), *(_round(c, digits).alias(c) for c in names))


@query("normalise_portable", _normal_sql(300, 11))
def _(spark, sf):
    return _rounded(N.normalise(daily(spark, sf), MODEL, n_samples=300, seed=11), ["observed", "normalised"])


@query("normalise_exhaustive", f"with {DAILY}, m as (select avg(quantity) as q, avg(discount) as d from daily) select cast(date as date) as date, round(1.23e-9 + value, 4) as observed, round(1.23e-9 + 20.0 + 1.5 * q - 2.0 * d + 1e-8 * epoch(date) + 0.25 * (isodow(date) - 1), 3) as normalised from daily, m")
def _(spark, sf):
    x = N.normalise(daily(spark, sf), MODEL, index="exhaustive")
    return x.select(F.to_date("date").alias("date"), _round("observed", 4).alias("observed"), _round("normalised", 3).alias("normalised"))


@query("normalise_quantiles", _normal_sql(300, 4, agg="select cast(date as date) as date, round(1.23e-9 + avg(p), 4) as normalised, round(1.23e-9 + quantile_cont(p, 0.05), 4) as q050, round(1.23e-9 + quantile_cont(p, 0.5), 4) as q500, round(1.23e-9 + quantile_cont(p, 0.95), 4) as q950 from x group by 1"))
def _(spark, sf):
    x = N.normalise(daily(spark, sf), MODEL, n_samples=300, seed=4, quantiles=[0.05, 0.5, 0.95])
    return _rounded(x, ["normalised", "q050", "q500", "q950"])


@query("normalise_conditional", _normal_sql(300, 9, pool=_POOL.replace("from daily", "from daily where quantity > 25")))
def _(spark, sf):
    return _rounded(N.normalise(daily(spark, sf), MODEL, n_samples=300, seed=9, conditional_on={"quantity": lambda c: c > 25}), ["observed", "normalised"])


@query("normalise_wide", _normal_sql(3, 2, agg="select cast(date as date) as date, round(1.23e-9 + avg(case when s = 0 then p end), 4) as s0, round(1.23e-9 + avg(case when s = 1 then p end), 4) as s1, round(1.23e-9 + avg(case when s = 2 then p end), 4) as s2 from x group by 1"))
def _(spark, sf):
    x = N.wide(N.normalise(daily(spark, sf), MODEL, n_samples=3, seed=2, aggregate=False), 3)
    return x.select(F.to_date("date").alias("date"), *(_round(str(i), 4).alias(f"s{i}") for i in range(3)))


@query("resample_joint", f"with {DAILY}, b as (select date, value, row_number() over (order by date) - 1 as i from daily), {_POOL}, d as (select b.*, (({R.portable_sql('b.i', '0', 6)}) * (select max(m) from pool)) >> 31 as k from b) select cast(date as date) as date, value, pq as quantity, pd as discount from d join pool using (k)")
def _(spark, sf):
    x = N.resample(daily(spark, sf).select("date", "value", "quantity", "discount"), ["quantity", "discount"], seed=6)
    return x.select(F.to_date("date").alias("date"), "value", "quantity", "discount")


_WINDOWS = "w as (select w, lo + cast(w * 60 as int) as a, lo + cast(w * 60 + 90 as int) as z from (select cast(min(date) as date) as lo, cast(max(date) as date) as hi from daily), lateral (select unnest(range((hi - lo - 90) // 60 + 1)) as w))"


def _rolling_normal(n: int, seed: int) -> str:
    idx = R.portable_sql("r.i", "(s.s + (r.w + 1) * 1000000)", seed)
    return (
        f"with {DAILY}, {_WINDOWS}, r as (select w.w, d.date, d.value, d.quantity, d.discount, epoch(d.date) as du, cast(isodow(d.date) - 1 as double) as wk, row_number() over (partition by w.w order by d.date, d.value) - 1 as i, count(*) over (partition by w.w) as m from daily d join w on cast(d.date as date) >= w.a and cast(d.date as date) < w.z), "
        f"s as (select unnest(range({n})) as s), x as (select r.w, r.date, r.du, r.wk, (({idx}) * r.m) >> 31 as k from r, s) "
        "select cast(x.date as date) as date, cast(x.w + 1 as int) as w, round(1.23e-9 + avg(20.0 + 1.5 * p.quantity - 2.0 * p.discount + 1e-8 * x.du + 0.25 * x.wk), 4) as normalised from x join r p on p.w = x.w and p.i = x.k group by 1, 2"
    )


@query("normalise_rolling", _rolling_normal(300, 8))
def _(spark, sf):
    x = N.normalise_rolling(daily(spark, sf), MODEL, n_samples=300, seed=8, window_days=90, every=60)
    return x.select(F.to_date("date").alias("date"), "w", _round("normalised", 4).alias("normalised"))


@query("normalise_auto")
def _(spark, sf):
    r = N.normalise_auto(daily(spark, sf), MODEL, batch_size=20, max_samples=200, tol="1%")
    return _rounded(r.result, ["observed", "normalised"]).withColumn("best_n", F.lit(r.best_n))


@query("multiscale")
def _(spark, sf):
    return N.multiscale(daily(spark, sf), MODEL, (30, 90, 365), n_samples=300)


_STATES = "select date, avg(value) as observed, avg({0}) as base, avg({1}) as s1, avg({2}) as s2 from x group by 1"


def _emission_sql(n: int, seed: int) -> str:
    pool = "pool as (select quantity as pq, discount as pd, epoch(date) as pdu, cast(isodow(date) - 1 as double) as pwk, row_number() over (order by date, quantity, discount, epoch(date), isodow(date)) - 1 as k, count(*) over () as m from daily)"
    met = "20.0 + 1.5 * pq - 2.0 * pd"
    y = _STATES.format(f"{met} + 1e-8 * pdu + 0.25 * pwk", f"{met} + 1e-8 * du + 0.25 * pwk", f"{met} + 1e-8 * du + 0.25 * wk")
    return _normal_sql(n, seed, pool, agg=f", y as ({y}) select cast(date as date) as date, round(1.23e-9 + observed, 4) as observed, round(1.23e-9 + s1 - base, 4) + 0.0 as date_unix, round(1.23e-9 + s2 - s1, 4) + 0.0 as weekday, round(1.23e-9 + s2, 4) as emi_total, round(1.23e-9 + (select avg(base) from y), 3) as emi_base, round(1.23e-9 + base - (select avg(base) from y), 3) + 0.0 as emi_noise from y")


@query("decompose_emission", _emission_sql(300, 13))
def _(spark, sf):
    x = D.decompose_emission(daily(spark, sf), MODEL, n_samples=300, seed=13)
    return x.select(F.to_date("date").alias("date"), _round("observed", 4).alias("observed"), (_round("date_unix", 4) + 0.0).alias("date_unix"), (_round("weekday", 4) + 0.0).alias("weekday"), _round("emi_total", 4).alias("emi_total"), _round("emi_base", 3).alias("emi_base"), (_round("emi_noise", 3) + 0.0).alias("emi_noise"))


def _meteorology_sql(n: int, seed: int) -> str:
    end = "1e-8 * du + 0.25 * wk"
    y = f"select date, avg(value) as observed, avg({_PRED}) as e, avg(20.0 + 1.5 * pq - 2.0 * discount + {end}) as d, avg(20.0 + 1.5 * quantity - 2.0 * discount + {end}) as q from x group by 1"
    return _normal_sql(n, seed, agg=f", y as ({y}), z as (select *, observed - e as t, avg(observed - e) over () as b from y) select cast(date as date) as date, round(1.23e-9 + e, 4) as emi_total, round(1.23e-9 + d - e, 4) + 0.0 as discount, round(1.23e-9 + q - d, 4) + 0.0 as quantity, round(1.23e-9 + t, 4) + 0.0 as met_total, round(1.23e-9 + b, 3) + 0.0 as met_base, round(1.23e-9 + t - b - (q - e), 3) + 0.0 as met_noise from z")


@query("decompose_meteorology", _meteorology_sql(300, 17))
def _(spark, sf):
    x = D.decompose_meteorology(daily(spark, sf), MODEL, n_samples=300, seed=17)
    return x.select(F.to_date("date").alias("date"), *((_round(c, 4) + 0.0).alias(c) for c in ("emi_total", "discount", "quantity", "met_total")), *((_round(c, 3) + 0.0).alias(c) for c in ("met_base", "met_noise")))


@query(
    "pdp_linear",
    f"with {DAILY}, q as (select quantile_cont(quantity, 0.01) as lo, quantile_cont(quantity, 0.99) as hi from daily), g as (select lo + (hi - lo) * k / 49 as v from q, (select unnest(range(50)) as k)) "
    "select 'quantity' as variable, round(1.23e-9 + v, 5) as value, round(1.23e-9 + avg(20.0 + 1.5 * v - 2.0 * discount + 1e-8 * epoch(date) + 0.25 * (isodow(date) - 1)), 4) as pdp_mean, round(1.23e-9 + stddev_samp(20.0 + 1.5 * v - 2.0 * discount + 1e-8 * epoch(date) + 0.25 * (isodow(date) - 1)), 4) as pdp_std from daily, g group by v",
)
def _(spark, sf):
    x = pdp(R.add_date_variables(daily(spark, sf)), MODEL, ["quantity"])
    return x.select("variable", _round("value", 5).alias("value"), _round("pdp_mean", 4).alias("pdp_mean"), _round("pdp_std", 4).alias("pdp_std"))


@query("linear_fit", f"with {DAILY} select 'quantity' as variable, 1.0 as scaled_importance, 1.0 as percentage, round(1.23e-9 + regr_slope(value, quantity), 4) as slope, round(1.23e-9 + regr_intercept(value, quantity), 2) as intercept from daily")
def _(spark, sf):
    m = train_model(daily(spark, sf), "value", ["quantity"])
    return feature_importance(spark, m).withColumns({"slope": _round(F.lit(m.slopes["quantity"]), 4), "intercept": _round(F.lit(m.intercept), 2)})


@query("gbt_normalise")
def _(spark, sf):
    d = R.add_date_variables(daily(spark, sf))
    m = train_model(d, "value", ["quantity", "discount", "date_unix", "weekday"], "gbt", {"n_trials": 1, "max_iter": 5})
    return _rounded(N.normalise(d, m, n_samples=20), ["observed", "normalised"])


@query("automl_board")
def _(spark, sf):
    return automl_leaderboard(daily(spark, sf), "value", ["quantity", "discount", "tax"], include=("forest", "linear", "glm"), folds=2)


# Panels and counterfactuals ------------------------------------------------------------------------------------------


@query("panel_coverage", f"with {GRID} select unit, round(1.23e-9 + pre, 6) as pre, round(1.23e-9 + post, 6) as post from cov")
def _(spark, sf):
    x = P.coverage(P.dense_grid(monthly(spark, sf), "M"), CUTOFF)
    return x.select("unit", _round("pre", 6).alias("pre"), _round("post", 6).alias("post"))


@query("panel_complete", f"with {FULL} select date, unit, round(1.23e-9 + outcome, 5) as outcome from full_panel")
def _(spark, sf):
    return complete(spark, sf)[0].select("date", "unit", _round("outcome", 5).alias("outcome"))


@query("panel_wide", f"with {MONTHLY} select date, max(case when unit = 'FRANCE' then outcome end) as \"FRANCE\", max(case when unit = 'GERMANY' then outcome end) as \"GERMANY\" from monthly group by 1")
def _(spark, sf):
    return P.to_wide(monthly(spark, sf), ["FRANCE", "GERMANY"], "mean")


_DID = (
    f"with {FULL}, tr as (select min(unit) as t from monthly), tasks as (select t as task, t as treated from tr union all select distinct unit, unit from full_panel, tr where unit <> t), "
    "day as (select k.task, f.date, avg(case when f.unit = k.treated then outcome end) as o, avg(case when f.unit <> k.treated and (k.task = t or f.unit <> t) then outcome end) as d from tasks k, full_panel f, tr group by 1, 2), "
    f"pre as (select task, avg(o) as mo, avg(d) as md from day where date < date '{CUTOFF}' group by 1), eff as (select day.task, date, o as observed, mo + d - md as synthetic, o - (mo + d - md) as effect from day join pre using (task))"
)


@query("did_effect", _DID + ", r as (select date, round(1.23e-9 + observed, 4) as observed, round(1.23e-9 + synthetic, 4) as synthetic, round(1.23e-9 + effect, 4) + 0.0 as effect from eff, tr where task = t) select * from r")
def _(spark, sf):
    p, t = complete(spark, sf)
    return S.run_scm(p, t, CUTOFF, method="did").select("date", _round("observed", 4).alias("observed"), _round("synthetic", 4).alias("synthetic"), (_round("effect", 4) + 0.0).alias("effect"))


def _placebos(spark, sf) -> tuple[DataFrame, str]:
    p, t = complete(spark, sf)
    return S.estimate(p, S.placebo_space_tasks(p, t, CUTOFF), "did"), t


@query("did_placebo_band", _DID + " select date, round(1.23e-9 + quantile_cont(effect, 0.1), 4) + 0.0 as p10, round(1.23e-9 + quantile_cont(effect, 0.9), 4) + 0.0 as p90, round(1.23e-9 + avg(effect), 4) + 0.0 as mean, round(1.23e-9 + stddev_samp(effect), 4) as std from eff, tr where task <> t group by 1")
def _(spark, sf):
    e, t = _placebos(spark, sf)
    return S.reference_band(e, t).select("date", *((_round(c, 4) + 0.0).alias(c) for c in ("p10", "p90", "mean")), _round("std", 4).alias("std"))


@query("did_p_value", _DID + f", s as (select task, avg(effect) as s from eff where date >= date '{CUTOFF}' group by 1), x as (select s.*, (select s from s, tr where task = t) as ts from s, tr where task <> t) select round(1.23e-9 + any_value(ts), 4) as stat, count(*) as n_placebos, round(1.23e-9 + (count(*) filter (where abs(s) >= abs(ts)) + 1) / (count(*) + 1), 6) as p_value from x")
def _(spark, sf):
    e, t = _placebos(spark, sf)
    return S.placebo_p(S.post_statistic(e, CUTOFF), t).select(_round("stat", 4).alias("stat"), "n_placebos", _round("p_value", 6).alias("p_value"))


@query("effect_bands_space", _DID + ", q as (select date, quantile_cont(effect, 0.025) as low, quantile_cont(effect, 0.975) as high from eff, tr where task <> t group by 1) select eff.date, round(1.23e-9 + effect, 4) + 0.0 as effect, round(1.23e-9 + low, 4) + 0.0 as low, round(1.23e-9 + high, 4) + 0.0 as high from eff join tr on task = t join q using (date)")
def _(spark, sf):
    e, t = _placebos(spark, sf)
    return S.effect_bands(e, t).select("date", *((_round(c, 4) + 0.0).alias(c) for c in ("effect", "low", "high")))


@query("rmspe_ratio", _DID + f", r as (select task, sqrt(avg(case when date < date '{CUTOFF}' then effect * effect end)) as a, sqrt(avg(case when date >= date '{CUTOFF}' then effect * effect end)) as b from eff group by 1) select task, round(1.23e-9 + a, 4) as pre_rmspe, round(1.23e-9 + b, 4) as post_rmspe, round(1.23e-9 + b / nullif(a, 0), 4) as ratio from r")
def _(spark, sf):
    e, _ = _placebos(spark, sf)
    return S.rmspe_ratios(e, CUTOFF).select("task", *(_round(c, 4).alias(c) for c in ("pre_rmspe", "post_rmspe", "ratio")))


@query("rmspe_test", _DID + f", r as (select task, sqrt(avg(case when date >= date '{CUTOFF}' then effect * effect end)) / sqrt(avg(case when date < date '{CUTOFF}' then effect * effect end)) as r from eff group by 1), x as (select r.r, (select r from r, tr where task = t) as t0 from r, tr where task <> t) select round(1.23e-9 + any_value(t0), 4) as ratio, round(1.23e-9 + (count(*) filter (where r >= t0) + 1) / (count(*) + 1), 6) as p_value, count(*) filter (where r > t0) + 1 as rank, count(*) as n from x")
def _(spark, sf):
    e, t = _placebos(spark, sf)
    return S.rmspe_ratio_test(e, CUTOFF, t).select(_round("ratio", 4).alias("ratio"), _round("p_value", 6).alias("p_value"), "rank", "n")


@query("conformal", _DID + f", e as (select date, effect, row_number() over (order by date) - 1 as i from eff, tr where task = t), k as (select avg(effect) filter (where date >= date '{CUTOFF}') as att, count(*) filter (where date >= date '{CUTOFF}') as np, count(*) filter (where date < date '{CUTOFF}') as nb from e), m as (select a.i, avg(b.effect) as m from e a, e b, k where b.i >= a.i and b.i < a.i + k.np and a.i <= k.nb group by 1) select round(1.23e-9 + any_value(att), 4) as att, round(1.23e-9 + (count(*) filter (where abs(m) >= abs(att) - 1e-12) + 1) / (count(*) + 1), 6) as p_value, round(1.23e-9 + quantile_cont(abs(m), 0.95), 4) as half_width, count(*) as n from m, k")
def _(spark, sf):
    p, t = complete(spark, sf)
    x = S.conformal_interval(S.run_scm(p, t, CUTOFF, method="did"), CUTOFF, n_perm=None)
    return x.select(_round("att", 4).alias("att"), _round("p_value", 6).alias("p_value"), _round("half_width", 4).alias("half_width"), "n")


@query("scm_diagnostics", _DID + f", e as (select *, date >= date '{CUTOFF}' as post from eff, tr where task = t) select round(1.23e-9 + sqrt(avg(effect * effect) filter (where not post)), 4) as pre_rmse, round(1.23e-9 + avg(abs(effect)) filter (where not post), 4) as pre_mae, round(1.23e-9 + avg(effect) filter (where post), 4) as att, round(1.23e-9 + sum(effect) filter (where post), 3) as cumulative, round(1.23e-9 + sqrt(avg(effect * effect) filter (where post)), 4) as post_rmse from e")
def _(spark, sf):
    p, t = complete(spark, sf)
    x = S.scm_diagnostics(S.run_scm(p, t, CUTOFF, method="did"), CUTOFF)
    return x.select(*(_round(c, 4).alias(c) for c in ("pre_rmse", "pre_mae", "att")), _round("cumulative", 3).alias("cumulative"), _round("post_rmse", 4).alias("post_rmse"))


@query("did_jackknife")
def _(spark, sf):
    p, t = complete(spark, sf)
    return S.uncertainty_bands(p, t, CUTOFF, kind="jackknife", method="did")


@query("did_placebo_time")
def _(spark, sf):
    p, t = complete(spark, sf)
    return S.placebo_in_time(p, t, "2000-06-01", method="did", min_pre=24, every=6)["band"]


def _one_fit(method: str, **settings):
    def run(spark, sf):
        p, t = complete(spark, sf)
        return S.run_tasks(p, S.tasks_table(spark, [(t, t, CUTOFF, S.donors_of(p, t))]), method, **settings)

    return run


for _m, _kw in {"scm": {}, "abadie": {}, "robust": {}, "mcnnm": {}, "bayes": {}, "mlscm": {}}.items():
    query(f"fit_{_m}")(_one_fit(_m, **_kw))


@query("scm_all_units")
def _(spark, sf):
    p, _ = complete(spark, sf)
    return S.scm_all(p, CUTOFF, "abadie")


@query("loo_stability")
def _(spark, sf):
    p, t = complete(spark, sf)
    return S.loo_weight_stability(p, t, CUTOFF, method="abadie")


# Time-series diagnostics ------------------------------------------------------------------------------------------------


@query("acf", f"with {HOURLY}, x as (select value - (select avg(value) from hourly) as x, row_number() over (order by date) as i from hourly), k as (select unnest(range(13)) as lag), s as (select lag, sum(a.x * b.x) as s from k, x a join x b on b.i = a.i - lag group by 1) select cast(lag as int) as lag, round(1.23e-9 + s / (select s from s where lag = 0), 6) as acf from s")
def _(spark, sf):
    return L.acf(hourly(spark, sf), "value", 12).select("lag", _round("acf", 6).alias("acf"))


@query("ccf_raw", f"with {HOURLY}, x as (select value as t, errors as d, row_number() over (order by date) as i from hourly), k as (select unnest(range(-6, 7)) as lag) select cast(lag as int) as lag, round(1.23e-9 + corr(b.d, a.t), 5) + 0.0 as ccf, count(*) as n from k, x a join x b on b.i = a.i - lag group by 1")
def _(spark, sf):
    return L.ccf(hourly(spark, sf), "errors", "value", 6).select("lag", (_round("ccf", 5) + 0.0).alias("ccf"), "n")


@query("ccf_prewhitened")
def _(spark, sf):
    return L.analyze_lag(hourly(spark, sf), "value", "errors", 12).ccf


_IQR = f"with {HOURLY}, q as (select quantile_cont(value, 0.25) as a, quantile_cont(value, 0.5) as b, quantile_cont(value, 0.75) as c from hourly), s as (select date, abs(value - b) / (c - a) as score from hourly, q)"


@query("anomaly_iqr", _IQR + " select strftime(date, '%Y-%m-%d %H') as date, round(1.23e-9 + score, 6) as score from s")
def _(spark, sf):
    return E.iqr_scores(hourly(spark, sf), "value").select(F.date_format("date", "yyyy-MM-dd HH").alias("date"), _round("score", 6).alias("score"))


@query("detect_events", _IQR + ", r as (select date, score, score > 0.8 as o, row_number() over (order by date) as i from s), g as (select *, i - row_number() over (partition by o order by date) as k from r) select strftime(min(date), '%Y-%m-%d %H') as start, strftime(max(date), '%Y-%m-%d %H') as \"end\", count(*) as n, round(1.23e-9 + max(score), 6) as max_score, round(1.23e-9 + avg(score), 6) as mean_score from g where o group by k having count(*) >= 2")
def _(spark, sf):
    x = E.detect_events(hourly(spark, sf), "value", k=0.8, min_length=2)
    return x.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), F.date_format("end", "yyyy-MM-dd HH").alias("end"), "n", _round("max_score", 6).alias("max_score"), _round("mean_score", 6).alias("mean_score"))


@query("anomaly_isolation")
def _(spark, sf):
    return E.isolation_scores(hourly(spark, sf), "value")


@query("anomaly_stl")
def _(spark, sf):
    return E.stl_scores(hourly(spark, sf), "value")


# Sources and joins ---------------------------------------------------------------------------------------------------------


@query("gdas_filenames", "select 'gdas1.' || lower(strftime(d, '%b')) || strftime(d, '%y') || '.w' || cast(least((day(d) - 1) // 7 + 1, 5) as varchar) as file, min(d) as first_day from (select cast(o_orderdate as date) as d from orders) group by 1")
def _(spark, sf):
    return trajectory.gdas1_filenames_df(table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date")))


_POINTS = "p as (select user_id, -(row_number() over (partition by user_id order by event_id) - 1) as age, 50 + (event_id % 100) / 50.0 as lat, -5 + (event_id * 7 % 100) / 20.0 as lon, 100.0 + event_id % 900 as height from events)"
_HAV = "2 * 6371.0 * asin(least(1, sqrt(power(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * power(sin(radians({d} - {b}) / 2), 2))))"


@query(
    "traj_features",
    f"with {_POINTS}, s as (select *, lead(lat) over w as lat2, lead(lon) over w as lon2 from p window w as (partition by user_id order by age desc)), "
    "g as (select user_id, arg_max(lat, age) as a, arg_max(lon, age) as b, arg_min(lat, age) as c, arg_min(lon, age) as d, max(age) - min(age) as span, avg(height) as hm, min(height) as hl, avg(case when lat between 50 and 51 and lon between -5 and -2 then 1.0 else 0.0 end) as r, coalesce(sum(" + _HAV.format(a="lat", b="lon", c="lat2", d="lon2") + "), 0) as path from s group by 1) "
    "select user_id, round(1.23e-9 + " + _HAV.format(a="a", b="b", c="c", d="d") + ", 3) as traj_dist_km, round(1.23e-9 + path, 3) as traj_pathlen_km, round(1.23e-9 + path / nullif(span, 0), 3) as traj_speed_kmh, round(1.23e-9 + hm, 4) as traj_height_mean, hl as traj_height_min, round(1.23e-9 + r, 6) as traj_resid_box from g",
)
def _(spark, sf):
    from pyspark.sql import Window

    e = table(spark, sf, "events")
    i = F.col("event_id")
    p = e.select("user_id", (1 - F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).cast("double").alias("age_h"), (50 + (i % 100) / 50.0).alias("lat"), (-5 + (i * 7 % 100) / 20.0).alias("lon"), (100.0 + i % 900).alias("height"))
    x = trajectory.trajectory_features(p, ["user_id"], {"box": (-5.0, 50.0, -2.0, 51.0)})
    return x.select("user_id", *(_round(c, 3).alias(c) for c in ("traj_dist_km", "traj_pathlen_km", "traj_speed_kmh")), _round("traj_height_mean", 4).alias("traj_height_mean"), "traj_height_min", _round("traj_resid_box", 6).alias("traj_resid_box"))


_NEAR = "with r as (select ts as t, event_id as rid, user_id from events where event_id % 7 = 0), l as (select ts as t, event_id as id, user_id from events where event_id % 7 <> 0)"


@query("asof_nearest", _NEAR + ", x as (select l.id, p.rid as pr, n.rid as nr, case when n.t is null or (p.t is not null and l.t - p.t <= n.t - l.t) then p.t else n.t end as bt from l asof left join (select t, user_id, max(rid) as rid from r group by 1, 2) p on l.user_id = p.user_id and l.t >= p.t asof left join (select t, user_id, min(rid) as rid from r group by 1, 2) n on l.user_id = n.user_id and l.t <= n.t) select id, strftime(bt, '%Y-%m-%d %H:%M:%S') as nearest from x")
def _(spark, sf):
    e = table(spark, sf, "events")
    left = e.where("event_id % 7 <> 0").select(F.col("event_id").alias("id"), "user_id", F.col("ts").alias("date"))
    right = e.where("event_id % 7 = 0").select("user_id", F.col("ts").alias("date"), F.col("ts").alias("hit"))
    return J.asof_nearest(left, right, "date", "user_id").select("id", F.date_format("hit", "yyyy-MM-dd HH:mm:ss").alias("nearest"))


@query("union_fill", "select n_nationkey as key, n_name as name, cast(null as double) as balance from nation union all select s_suppkey, s_name, s_acctbal from supplier")
def _(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return J.union_fill([n, s])


@query("dedupe_last", "select o_custkey, max(o_orderkey) as o_orderkey from orders group by 1")
def _(spark, sf):
    return J.dedupe(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])


@query("merge_outer", "with a as (select user_id, count(*) as clicks from events where event_type = 'click' group by 1), b as (select user_id, count(*) as errors from events where event_type = 'error' group by 1) select coalesce(a.user_id, b.user_id) as user_id, clicks, errors from a full join b on a.user_id = b.user_id")
def _(spark, sf):
    e = table(spark, sf, "events")
    part = lambda k, n: e.where(F.col("event_type") == k).groupBy("user_id").agg(F.count("*").alias(n))
    return J.merge_outer([part("click", "clicks"), part("error", "errors")], ["user_id"])


@query("fetch_merge", f"with {HOURLY}, w as (select date_trunc('hour', ts) as date, round(1.23e-9 + avg(case when event_type = 'click' then value end), 4) as click, round(1.23e-9 + avg(case when event_type = 'error' then value end), 4) as error from events where value > 5 group by 1) select strftime(w.date, '%Y-%m-%d %H') as date, click, error, h.n from w left join hourly h on h.date = w.date where click is not null or error is not null")
def _(spark, sf):
    e = table(spark, sf, "events").where(F.col("event_type").isin("click", "error")).select(F.date_trunc("hour", "ts").alias("date"), F.col("event_type").alias("pollutant"), "value")
    x = J.fetch_merge(e, hourly(spark, sf).select("date", "n"), floor=5.0, pollutants=["click", "error"])
    return x.select(F.date_format("date", "yyyy-MM-dd HH").alias("date"), _round("click", 4).alias("click"), _round("error", 4).alias("error"), "n")


@query("rounded_time_join", "with l as (select event_id, user_id, make_timestamp(cast(round_even(epoch(ts) / 21600, 0) as bigint) * 21600 * 1000000) as k from events), r as (select user_id, make_timestamp(cast(floor(epoch(ts) / 21600) as bigint) * 21600 * 1000000) as k, count(*) as n, round(1.23e-9 + avg(value), 6) as value from events group by 1, 2) select event_id, strftime(k, '%Y-%m-%d %H') as slot, n, value from l join r using (user_id, k)")
def _(spark, sf):
    e = table(spark, sf, "events")
    six = e.groupBy("user_id", F.window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"), _round(F.avg("value"), 6).alias("value")).withColumn("date", F.col("w.start"))
    x = J.rounded_time_join(e.select("event_id", "user_id", F.col("ts").alias("date")), six.drop("w"), 21600, by=["user_id"])
    return x.select("event_id", F.date_format("date", "yyyy-MM-dd HH").alias("slot"), "n", "value")


@query("topk_totals", "select o_custkey, round(1.23e-9 + sum(o_totalprice), 2) as total from orders group by 1 order by sum(o_totalprice) desc, o_custkey limit 10")
def _(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(_round(F.sum("o_totalprice"), 2).alias("total")).orderBy(F.desc("total"), "o_custkey").limit(10)


@query("station_rollup", "with d as (select distinct user_id, event_type from events) select cast(user_id as varchar) as site, string_agg(event_type, ',' order by event_type) as pollutants, cast(count(*) as int) as n from d group by 1")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("site"), F.col("event_type").alias("pollutant"))
    return stations.station_rollup(e)


@query("ensemble_summary", f"with {DAILY}, l as (select date, value * 1.0 as v, 0.5 as w from daily union all select date, quantity, 0.3 from daily union all select date, tax, 0.2 from daily) select cast(date as date) as date, round(1.23e-9 + avg(v), 4) as mean, round(1.23e-9 + stddev_samp(v), 4) as std, round(1.23e-9 + quantile_cont(v, 0.5), 4) as median, round(1.23e-9 + quantile_cont(v, 0.025), 4) as lower_bound, round(1.23e-9 + quantile_cont(v, 0.975), 4) as upper_bound, round(1.23e-9 + sum(v * w) / sum(w), 4) as weighted from l group by 1")
def _(spark, sf):
    d = daily(spark, sf)
    long = d.select("date", F.col("value").alias("v"), F.lit(0.5).alias("w")).unionByName(d.select("date", F.col("quantity").alias("v"), F.lit(0.3).alias("w"))).unionByName(d.select("date", F.col("tax").alias("v"), F.lit(0.2).alias("w")))
    return _rounded(M.ensemble(long, "v", weight="w"), ["mean", "std", "median", "lower_bound", "upper_bound", "weighted"])


@query("multisite_linear", "with s as (select event_type as site, date_trunc('hour', ts) as date, avg(value) as value, cast(count(*) as double) as n from events group by 1, 2), m as (select site, regr_slope(value, n) as b, regr_intercept(value, n) as a, avg(n) as q from s group by 1) select s.site, strftime(date, '%Y-%m-%d %H') as date, round(1.23e-9 + value, 4) as observed, round(1.23e-9 + a + b * q, 3) as normalised from s join m using (site)")
def _(spark, sf):
    from .plans.orchestrate import multisite

    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("site"), F.date_trunc("hour", "ts").alias("date")).agg(F.avg("value").alias("value"), F.count("*").cast("double").alias("n"))
    out, _ = multisite(e, "site", lambda d: N.normalise(d, train_model(d, "value", ["n"]), index="exhaustive"), parallelism=4)
    return out.select("site", F.date_format("date", "yyyy-MM-dd HH").alias("date"), _round("observed", 4).alias("observed"), _round("normalised", 3).alias("normalised"))


from . import queries_more  # noqa: E402, F401  registers further queries
