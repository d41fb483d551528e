"""Further queries: joins, fills, panels, inference and plot tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import features as X
from .models.base import encoded
from .models.explain import axis_rank, verdict
from .operators import events as E
from .operators import joins as J
from .operators import panel as P
from .operators import prepare as R
from .operators import scm as S
from .queries import _DID, _IQR, _SQL, CUTOFF, DAILY, FULL, HOURLY, MONTHLY, _round, complete, daily, hourly, monthly, query, table
from .schema import safe_name
from .sources import report

_SLOT = "make_timestamp(cast(round_even(epoch({}) / 21600, 0) as bigint) * 21600 * 1000000)"


@query("rounded_time_meet", f"with {HOURLY}, l as (select event_id, {_SLOT.format('ts')} as k from events), r as (select {_SLOT.format('date')} as k, n from hourly where hour(date) % 6 = 0) select event_id, strftime(k, '%Y-%m-%d %H') as slot, n from l join r using (k)")
def _(spark, sf):
    left = table(spark, sf, "events").select("event_id", F.col("ts").alias("date"))
    right = hourly(spark, sf).where(F.hour("date") % 6 == 0).select("date", "n")
    return J.rounded_time_join(left, right, 21600).select("event_id", F.date_format("date", "yyyy-MM-dd HH").alias("slot"), "n")


_GAPS = "gaps as (select date, case when n % 3 <> 0 then value end as value from hourly)"


@query("locf", f"with {HOURLY}, {_GAPS} select strftime(date, '%Y-%m-%d %H') as date, coalesce(last_value(value ignore nulls) over (order by date rows between unbounded preceding and current row), first_value(value ignore nulls) over (order by date rows between current row and unbounded following)) as value from gaps")
def _(spark, sf):
    x = hourly(spark, sf).select("date", F.when(F.col("n") % 3 != 0, F.col("value")).alias("value"))
    return E.locf(x, "value").select(F.date_format("date", "yyyy-MM-dd HH").alias("date"), "value")


@query("locf_by_user", "select event_id, coalesce(last_value(case when event_id % 4 <> 0 then value end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row), first_value(case when event_id % 4 <> 0 then value end ignore nulls) over (partition by user_id order by event_id rows between current row and unbounded following)) as value from events")
def _(spark, sf):
    x = table(spark, sf, "events").select("event_id", "user_id", F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("value"))
    return E.locf(x, "value", "event_id", "user_id").select("event_id", "value")


@query("detect_cutoff", _IQR + ", r as (select date, score, score > 0.8 as o, row_number() over (order by date) as i from s), g as (select *, i - row_number() over (partition by o order by date) as k from r), e as (select min(date) as start, max(score) as top from g where o group by k having count(*) >= 2) select strftime(start, '%Y-%m-%d %H') as cutoff from e order by top desc, start limit 1")
def _(spark, sf):
    cut = E.detect_cutoff(hourly(spark, sf), "value", k=0.8, min_length=2)
    return spark.createDataFrame([(cut,)], "cutoff timestamp").where("cutoff is not null").select(F.date_format("cutoff", "yyyy-MM-dd HH").alias("cutoff"))


@query("panel_round_trip", f"with {MONTHLY} select d.date, u.unit, m.outcome from (select distinct date from monthly) d cross join (select distinct unit from monthly) u left join monthly m on m.date = d.date and m.unit = u.unit")
def _(spark, sf):
    m = monthly(spark, sf)
    units = S.units_of(m)
    return P.to_long(P.to_wide(m, units), units)


@query("intervals_overlap", "with o as (select l_orderkey, min(l_shipdate) as a, max(l_shipdate) as b from lineitem group by 1) select l_orderkey, cast(a as date) as first, cast(b as date) as last from o where cast(a as date) <= date '1998-06-30' and cast(b as date) >= date '1998-06-01'")
def _(spark, sf):
    o = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.to_date(F.min("l_shipdate")).alias("first"), F.to_date(F.max("l_shipdate")).alias("last"))
    return J.overlapping(o, "first", "last", "1998-06-01", "1998-06-30")


_PLACE = "(50 + (event_id % 100) / 50.0) as la, (-5 + (event_id * 7 % 100) / 20.0) as lo, (48 + (event_id * 3 % 100) / 25.0) as lb, (2 + (event_id * 11 % 100) / 10.0) as lp"


@query("bearing", f"with p as (select event_id, {_PLACE} from events) select event_id, round(1.23e-9 + fmod(degrees(atan2(sin(radians(lp - lo)) * cos(radians(lb)), cos(radians(la)) * sin(radians(lb)) - sin(radians(la)) * cos(radians(lb)) * cos(radians(lp - lo)))) + 360, 360), 4) as bearing from p")
def _(spark, sf):
    i = F.col("event_id")
    b = X.bearing_deg(50 + (i % 100) / 50.0, -5 + (i * 7 % 100) / 20.0, 48 + (i * 3 % 100) / 25.0, 2 + (i * 11 % 100) / 10.0)
    return table(spark, sf, "events").select("event_id", _round(b, 4).alias("bearing"))


@query("unit_conversions", "select event_id, round(1.23e-9 + value + 273.15, 5) as c_to_k, round(1.23e-9 + value * 100.0, 5) as hpa_to_pa, round(1.23e-9 + value / 100.0, 5) as percent_to_fraction, round(1.23e-9 + value / 1000.0, 6) as mm_to_m, round(1.23e-9 + value * 3600.0, 4) as w_to_j from events")
def _(spark, sf):
    digits = {"c_to_k": 5, "hpa_to_pa": 5, "percent_to_fraction": 5, "mm_to_m": 6, "w_to_j": 4}
    return table(spark, sf, "events").select("event_id", *(_round(X.convert_units(F.col("value"), k), d).alias(k) for k, d in digits.items()))


@query("region_with_hole", "with p as (select event_id, (event_id % 101) / 10.0 + 0.013 as x, (event_id * 7 % 103) / 10.0 + 0.017 as y from events) select event_id, (x between 1 and 9 and y between 1 and 9 and not (x between 4 and 6 and y between 4 and 6)) as inside from p")
def _(spark, sf):
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    i = F.col("event_id")
    e = table(spark, sf, "events").select("event_id", ((i % 101) / 10.0 + 0.013).alias("lon"), ((i * 7 % 103) / 10.0 + 0.017).alias("lat"))
    return J.points_in_regions(e, {"r": [square(1.0, 9.0), square(4.0, 6.0)]}).select("event_id", F.col("in_r").alias("inside"))


_LABELS = "l as (select distinct monthname(o_orderdate) as label from orders union select distinct dayname(o_orderdate) from orders union select distinct left(dayname(o_orderdate), 3) from orders union select distinct cast(day(o_orderdate) as varchar) from orders union select distinct o_orderpriority from orders union select distinct c_mktsegment from customer)"


@query(
    "axis_order",
    f"with {_LABELS}, k as (select label, try_cast(label as double) as x, list_position(['mon','tue','wed','thu','fri','sat','sun','monday','tuesday','wednesday','thursday','friday','saturday','sunday'], lower(label)) as d, list_position(['january','february','march','april','may','june','july','august','september','october','november','december'], lower(label)) as m from l) "
    "select label, case when x is not null then 0 when d is not null or m is not null then 1 else 2 end as kind, coalesce(x, cast((d - 1) % 7 as double), cast(m - 1 as double), 0.0) as rank from k",
)
def _(spark, sf):
    o, day = table(spark, sf, "orders"), F.date_format("o_orderdate", "EEEE")
    parts = [o.select(F.date_format("o_orderdate", "MMMM")), o.select(day), o.select(F.substring(day, 1, 3)), o.select(F.dayofmonth("o_orderdate").cast("string")), o.select("o_orderpriority"), table(spark, sf, "customer").select("c_mktsegment")]
    labels = parts[0].toDF("label")
    for p in parts[1:]:
        labels = labels.unionByName(p.toDF("label"))
    r = labels.distinct().withColumn("r", axis_rank(F.col("label")))
    return r.select("label", F.col("r.kind").alias("kind"), F.col("r.rank").alias("rank"))


@query("sanitised_and_encoded", "with x as (select event_id, coalesce(case when event_id % 5 <> 0 then event_type end, 'Missing') as kind, value from events), l as (select kind, row_number() over (order by kind) - 1 as i from (select distinct kind from x)) select event_id, kind, cast(i as double) as code, case when event_id % 7 <> 0 then value else 0.0 end as value from x join l using (kind)")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("kind"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))
    x = R.sanitise_categories(e)
    levels = {"kind": sorted(r[0] for r in x.select("kind").distinct().collect())}
    code = encoded(x, ["kind", "value"], levels)
    return x.select("event_id", "kind", code["kind"].alias("code"), code["value"].alias("value"))


@query("safe_names", "select distinct event_type as name, trim(regexp_replace(regexp_replace('2. ' || event_type || ' (x)', '[^A-Za-z0-9_]', '_', 'g'), '_+', '_', 'g'), '_') as bare, 'v_' || trim(regexp_replace(regexp_replace('2. ' || event_type || ' (x)', '[^A-Za-z0-9_]', '_', 'g'), '_+', '_', 'g'), '_') as safe from events")
def _(spark, sf):
    names = sorted(r[0] for r in table(spark, sf, "events").select("event_type").distinct().collect())
    return spark.createDataFrame([(n, safe_name(f"2. {n} (x)")[2:], safe_name(f"2. {n} (x)")) for n in names], "name string, bare string, safe string")


@query("verdicts", "select event_id, case when value / 100 >= 0.7 then 'ok' when value / 100 >= 0.4 then 'warn' else 'error' end as verdict from events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", verdict(F.col("value") / 100, 0.7, 0.4).alias("verdict"))


@query("every_seventh", f"with {HOURLY}, r as (select *, row_number() over (order by date) - 1 as i from hourly) select strftime(date, '%Y-%m-%d %H') as date, value from r where i % 7 = 0")
def _(spark, sf):
    x = hourly(spark, sf).withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)
    return x.where("i % 7 = 0").select(F.date_format("date", "yyyy-MM-dd HH").alias("date"), "value")


@query("pre_period_means", f"with {MONTHLY} select unit, round(1.23e-9 + avg(outcome), 5) as outcome from monthly where date < date '{CUTOFF}' group by 1")
def _(spark, sf):
    return P.pre_period_means(monthly(spark, sf), "unit", ["outcome"], CUTOFF).select("unit", _round("outcome", 5).alias("outcome"))


@query("panel_balance", f"with {MONTHLY}, n as (select count(distinct unit) as n_units, count(distinct date) as n_dates, count(outcome) as have, count(distinct case when date < date '{CUTOFF}' then date end) as n_pre from monthly) select n_units, n_dates, round(1.23e-9 + 100.0 * (1 - have / (n_units * n_dates)), 5) as missing_percent, n_pre, case when 100.0 * (1 - have / (n_units * n_dates)) > 10 or n_pre < 10 then 'warn' else 'ok' end as verdict from n")
def _(spark, sf):
    return P.panel_balance(monthly(spark, sf), "date", "unit", "outcome", CUTOFF).select("n_units", "n_dates", _round("missing_percent", 5).alias("missing_percent"), "n_pre", "verdict")


@query("did_all_units", f"with {FULL}, day as (select k.unit, f.date, avg(case when f.unit = k.unit then outcome end) as o, avg(case when f.unit <> k.unit then outcome end) as d from (select distinct unit from full_panel) k, full_panel f group by 1, 2), pre as (select unit, avg(o) as mo, avg(d) as md from day where date < date '{CUTOFF}' group by 1) select unit, date, round(1.23e-9 + o, 4) as observed, round(1.23e-9 + o - (mo + d - md), 4) + 0.0 as effect from day join pre using (unit)")
def _(spark, sf):
    p, _ = complete(spark, sf)
    return S.scm_all(p, CUTOFF, method="did").select("unit", "date", _round("observed", 4).alias("observed"), (_round("effect", 4) + 0.0).alias("effect"))


_JACK = (
    f"with {FULL}, tr as (select min(unit) as t from monthly), k as (select distinct unit as task from full_panel union all select ''), "
    "day as (select k.task, f.date, avg(case when f.unit = t then outcome end) as o, avg(case when f.unit <> t and f.unit <> k.task then outcome end) as d from k, full_panel f, tr where k.task <> t group by 1, 2), "
    f"pre as (select task, avg(o) as mo, avg(d) as md from day where date < date '{CUTOFF}' group by 1), eff as (select day.task, date, o - (mo + d - md) as effect from day join pre using (task)), "
    "s as (select date, count(*) as n, sqrt((count(*) - 1) * var_pop(effect)) as se from eff where task <> '' group by 1) "
)


@query("did_jackknife_bands", _JACK + "select date, round(1.23e-9 + effect, 4) + 0.0 as effect, round(1.23e-9 + effect - 1.959963984540054 * se, 4) + 0.0 as low, round(1.23e-9 + effect + 1.959963984540054 * se, 4) + 0.0 as high, n from eff join s using (date) where task = ''")
def _(spark, sf):
    p, t = complete(spark, sf)
    return S.uncertainty_bands(p, t, CUTOFF, kind="jackknife", method="did").select("date", *((_round(c, 4) + 0.0).alias(c) for c in ("effect", "low", "high")), "n")


@query("effect_bands_std", _DID + ", q as (select date, avg(effect) as m, stddev_samp(effect) as s from eff, tr where task <> t group by 1) select eff.date, round(1.23e-9 + effect, 4) + 0.0 as effect, round(1.23e-9 + m - 1.959963984540054 * s, 4) + 0.0 as low, round(1.23e-9 + m + 1.959963984540054 * s, 4) + 0.0 as high from eff join tr on task = t join q using (date)")
def _(spark, sf):
    p, t = complete(spark, sf)
    e = S.estimate(p, S.placebo_space_tasks(p, t, CUTOFF), "did")
    return S.effect_bands(e, t, method="std").select("date", *((_round(c, 4) + 0.0).alias(c) for c in ("effect", "low", "high")))


_SITES = "s as (select event_type as site, date_trunc('hour', ts) as date, round(1.23e-9 + avg(value), 5) as value from events group by 1, 2)"


@query("sites_in_order", f"with {_SITES} select site, strftime(date, '%Y-%m-%d %H') as date, value, row_number() over (order by site, date) as place from s order by site, date limit 50")
def _(spark, sf):
    s = table(spark, sf, "events").groupBy(F.col("event_type").alias("site"), F.date_trunc("hour", "ts").alias("date")).agg(_round(F.avg("value"), 5).alias("value"))
    head = s.orderBy("site", "date").limit(50)
    return head.withColumn("place", F.row_number().over(Window.orderBy("site", "date"))).select("site", F.date_format("date", "yyyy-MM-dd HH").alias("date"), "value", "place")


@query("match_or_nearest", "with l as (select s_suppkey, case when s_suppkey % 3 = 0 then ' Place ' || (s_suppkey % 40) else 'unknown' end as name, (s_suppkey * 7 % 1000) / 100.0 as lat, (s_suppkey * 13 % 1000) / 100.0 as lon from supplier), r as (select c_custkey as code, 'place ' || c_custkey as name, (c_custkey * 11 % 1000) / 100.0 as lat, (c_custkey * 17 % 1000) / 100.0 as lon from customer), a as (select l.*, (select min(code) from r where r.name = lower(trim(l.name))) as c1 from l), b as (select s_suppkey, code, sqrt(pow(a.lat - r.lat, 2) + pow(a.lon - r.lon, 2)) as d from a, r where c1 is null), c as (select s_suppkey, arg_min(code, round(d, 9) * 1e9 + code * 1e-3) as c2 from b where d < 0.155 group by 1) select a.s_suppkey, coalesce(c1, c2) as code from a left join c using (s_suppkey)")
def _(spark, sf):
    i, c = F.col("s_suppkey"), F.col("c_custkey")
    left = table(spark, sf, "supplier").select("s_suppkey", F.when(i % 3 == 0, F.concat(F.lit(" Place "), (i % 40).cast("string"))).otherwise("unknown").alias("name"), ((i * 7 % 1000) / 100.0).alias("lat"), ((i * 13 % 1000) / 100.0).alias("lon"))
    right = table(spark, sf, "customer").select(c.alias("code"), F.concat(F.lit("place "), c.cast("string")).alias("name"), ((c * 11 % 1000) / 100.0).alias("lat"), ((c * 17 % 1000) / 100.0).alias("lon"))
    return J.match_or_nearest(left, right, "name", within=0.155).select("s_suppkey", "code")


@query("plot_series", f"with {DAILY} select cast(date as date) as date, series, v as value from daily, unnest([{{'series': 'value', 'v': value}}, {{'series': 'n', 'v': n}}, {{'series': 'quantity', 'v': quantity}}, {{'series': 'discount', 'v': discount}}, {{'series': 'tax', 'v': tax}}]) as t(x), lateral (select x.series as series, x.v as v)")
def _(spark, sf):
    return report.time_series_data(daily(spark, sf)).select(F.to_date("date").alias("date"), "series", "value")


@query("plot_polar", _SQL["polar_bins"])
def _(spark, sf):
    e = table(spark, sf, "events").select("value", (F.col("event_id") * 37 % 360).cast("double").alias("wd"))
    return report.polar_data(e, "value", "value", "wd").select("theta", _round("r", 5).alias("r"), _round("statistic", 5).alias("statistic"), "n")


@query("plot_bands", f"select date as x, effect, low, high from ({_SQL['effect_bands_space']})")
def _(spark, sf):
    p, t = complete(spark, sf)
    e = S.estimate(p, S.placebo_space_tasks(p, t, CUTOFF), "did")
    return report.band_data(S.effect_bands(e, t)).select("x", *((_round(c, 4) + 0.0).alias(c) for c in ("effect", "low", "high")))


@query("plot_path", _SQL["did_effect"])
def _(spark, sf):
    p, t = complete(spark, sf)
    path, _ = report.scm_dashboard_data(S.run_scm(p, t, CUTOFF, method="did"), spark.createDataFrame([], "donor string, weight double"))
    return path.select("date", _round("observed", 4).alias("observed"), _round("synthetic", 4).alias("synthetic"), (_round("effect", 4) + 0.0).alias("effect"))
