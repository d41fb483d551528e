"""Counterfactuals: every fit is a row of a tasks table, solved in a grouped map.

A task is (task, treated, cutoff, donors): one treated unit, all units in turn, placebos in space or in
time, bootstrap and jackknife replicates are all such tables, so each operator is one join of the panel
with its tasks and one grouped map. A group is one block of periods x (donors + 1), the estimator's
own input size. Failed fits give a row with ``error`` rather than ending the job.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigError, DataError, warn_experimental
from ..operators.panel import did_effects, task_units
from ..schema import finite, ratio
from .solvers import FITS

PATH = "task string, kind string, date date, unit string, observed double, synthetic double, effect double, low double, high double, weight double, error string"


def units_of(panel: DataFrame) -> list[str]:
    return sorted(r[0] for r in panel.select("unit").distinct().collect())


def donors_of(panel: DataFrame, treated: str, donors: list[str] | None = None) -> list[str]:
    """Given donors that exist, or all other units."""
    have = [u for u in units_of(panel) if u != treated]
    out = [d for d in donors if d in have] if donors else have
    if not out:
        raise DataError("no donors")
    return out


def tasks_table(spark, rows: list[tuple[str, str, str, list[str]]]) -> DataFrame:
    """(task, treated, cutoff, donors); a row a fit."""
    return spark.createDataFrame([(t, u, str(c), list(d)) for t, u, c, d in rows], "task string, treated string, cutoff string, donors array<string>")


def run_tasks(panel: DataFrame, tasks: DataFrame, method: str = "scm", pre_covariates: DataFrame | None = None, **settings) -> DataFrame:
    """Rows of kind "path" (task, date, observed, synthetic, effect, low, high), "weight" (task, unit, weight) and "error".

    ``pre_covariates``, a row a unit (see ``pre_period_means``), is matched along with the outcomes by method "scm".
    """
    if method not in FITS:
        raise ConfigError(f"unknown estimator {method}; known: {', '.join(FITS)}")
    if method == "mlscm":
        warn_experimental("mlscm")
    fit = FITS[method]
    if pre_covariates is not None and method != "scm":
        raise ConfigError("only scm matches covariates")
    x = panel.select("date", "unit", "outcome").join(task_units(tasks), "unit")
    extra = [c for c in pre_covariates.columns if c != "unit"] if pre_covariates is not None else []
    if extra:
        x = x.join(pre_covariates.select("unit", *(finite(c).alias(f"__c{i}") for i, c in enumerate(extra))), "unit", "left")
    names = [c.split()[0] for c in PATH.split(", ")]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        task, treated, cut = pdf["task"].iloc[0], pdf["__tr"].iloc[0], pd.Timestamp(pdf["cutoff"].iloc[0])
        try:
            w = pdf.pivot_table(index="date", columns="unit", values="outcome", aggfunc="last", dropna=False).sort_index()
            donors = [c for c in w.columns if c != treated]
            if treated not in w.columns or not donors:
                raise ValueError("the treated unit or its donors are missing")
            y, m = w[treated].to_numpy(float), w[donors].to_numpy(float)
            pre = pd.to_datetime(pd.Series(w.index)).to_numpy() < cut.to_datetime64()
            own = {}
            if extra:
                given = pdf.groupby("unit")[[f"__c{i}" for i in range(len(extra))]].first().reindex([treated, *donors]).to_numpy(float)
                if not np.isfinite(given).all():
                    raise ValueError("a covariate is missing")
                own["covariates"] = given
            r = fit(y, m, pre, **own, **settings)
            s = np.asarray(r["synthetic"], float)
            low, high = (y - r["synthetic_high"], y - r["synthetic_low"]) if "synthetic_high" in r else (np.full(len(y), np.nan),) * 2
            nothing = np.full(len(donors), np.nan)
            rows = [(task, "path", d, None, *v, None, None) for d, *v in zip(w.index, y, s, y - s, low, high, strict=True)]
            rows += [(task, "weight", None, u, None, None, None, lo, hi, v, None) for u, v, lo, hi in zip(donors, r["weights"], r.get("weights_low", nothing), r.get("weights_high", nothing), strict=True)]
        except Exception as e:
            rows = [(task, "error", *[None] * 8, str(e)[:300])]
        out = pd.DataFrame(rows, columns=names, dtype=object)
        return out.astype(dict.fromkeys(("observed", "synthetic", "effect", "low", "high", "weight"), float))

    return x.groupBy("task").applyInPandas(one, PATH)


def paths(fits: DataFrame) -> DataFrame:
    return fits.where("kind = 'path'").select("task", "date", "observed", "synthetic", "effect", "low", "high")


def weights(fits: DataFrame) -> DataFrame:
    return fits.where("kind = 'weight'").select("task", F.col("unit").alias("donor"), "weight", "low", "high")


def estimate(panel: DataFrame, tasks: DataFrame, method: str = "scm", **settings) -> DataFrame:
    """(task, date, observed, synthetic, effect) by any estimator; did stays relational."""
    if method == "did":
        return did_effects(panel, tasks)
    return paths(run_tasks(panel, tasks, method, **settings)).drop("low", "high")


def run_scm(panel: DataFrame, treated: str, cutoff, donors: list[str] | None = None, method: str = "scm", **settings) -> DataFrame:
    """(date, observed, synthetic, effect) of one treated unit."""
    t = tasks_table(panel.sparkSession, [(treated, treated, cutoff, donors_of(panel, treated, donors))])
    return estimate(panel, t, method, **settings).drop("task")


def scm_all(panel: DataFrame, cutoff, method: str = "scm", donors: list[str] | None = None, **settings) -> DataFrame:
    """Every unit as treated in turn, by any estimator: (unit, date, observed, synthetic, effect)."""
    units = units_of(panel)
    rows = [(u, u, cutoff, [d for d in (donors or units) if d != u]) for u in units]
    return estimate(panel, tasks_table(panel.sparkSession, rows), method, **settings).withColumnRenamed("task", "unit")


def placebo_space_tasks(panel: DataFrame, treated: str, cutoff, donors: list[str] | None = None, scope: str = "donors") -> DataFrame:
    """The true fit and each donor as treated, without the treated unit; scope="all" also lends units that are no donors."""
    mine = donors_of(panel, treated, donors)
    pool = mine if scope == "donors" else [u for u in units_of(panel) if u != treated]
    return tasks_table(panel.sparkSession, [(treated, treated, cutoff, mine), *((d, d, cutoff, [u for u in pool if u != d]) for d in mine)])


def placebo_time_tasks(panel: DataFrame, treated: str, cutoff, donors: list[str] | None = None, min_pre: int = 30, every: int = 7) -> DataFrame:
    """Pseudo-cutoffs before the true one, each with a whole post-length segment before it; none if history is short."""
    dates = [r[0] for r in panel.where(F.col("unit") == treated).select("date").distinct().orderBy("date").collect()]
    pre = [d for d in dates if str(d) < str(cutoff)]
    post = len(dates) - len(pre)
    mine = donors_of(panel, treated, donors)
    cuts = [pre[i] for i in range(min_pre, len(pre) - post + 1)][::every] if post else []
    return tasks_table(panel.sparkSession, [("true", treated, cutoff, mine), *((str(c), treated, c, mine) for c in cuts if str(c) != str(cutoff))])


def post_statistic(effects: DataFrame, cutoff, agg: str = "mean") -> DataFrame:
    """(task, stat) of the effects from the cutoff on."""
    f = F.avg if agg == "mean" else F.sum
    return effects.where(F.col("date") >= F.lit(str(cutoff)).cast("date")).groupBy("task").agg(f("effect").alias("stat"))


def placebo_p(stats: DataFrame, true: str) -> DataFrame:
    """One row: p = (placebos as extreme + 1) / (valid + 1)."""
    t = stats.where(F.col("task") == true).select(F.col("stat").alias("true_stat"))
    x = stats.where((F.col("task") != true) & F.col("stat").isNotNull()).crossJoin(F.broadcast(t))  # one row
    return x.agg(F.first("true_stat").alias("stat"), F.count("*").alias("n_placebos"), ((F.count_if(F.abs("stat") >= F.abs("true_stat")) + 1) / (F.count("*") + 1)).alias("p_value"))


def reference_band(effects: DataFrame, true: str) -> DataFrame:
    """Spread of the placebos' effects by date."""
    q = F.percentile("effect", [0.1, 0.9, 0.025, 0.975])
    x = effects.where(F.col("task") != true).groupBy("date").agg(q.alias("q"), F.avg("effect").alias("mean"), F.stddev_samp("effect").alias("std"))
    return x.select("date", *(F.col("q")[i].alias(n) for i, n in enumerate(("p10", "p90", "p2_5", "p97_5"))), "mean", "std", (F.col("mean") - F.col("std")).alias("band_low_1sd"), (F.col("mean") + F.col("std")).alias("band_high_1sd"))


def placebo_in_space(panel: DataFrame, treated: str, cutoff, donors: list[str] | None = None, method: str = "scm", scope: str = "donors", post_agg: str = "mean", **settings) -> dict[str, DataFrame]:
    e = estimate(panel, placebo_space_tasks(panel, treated, cutoff, donors, scope), method, **settings)
    return {"effects": e, "p_value": placebo_p(post_statistic(e, cutoff, post_agg), treated), "band": reference_band(e, treated)}


def event_segments(effects: DataFrame, tasks: DataFrame, n_post: int) -> DataFrame:
    """Effects from each task's own cutoff on, by event time 0, 1, ... below ``n_post``."""
    x = effects.join(F.broadcast(tasks.select("task", F.col("cutoff").cast("date").alias("__c"))), "task").where("date >= __c")
    t = F.row_number().over(Window.partitionBy("task").orderBy("date")) - 1
    return x.withColumn("event_time", t).where(F.col("event_time") < n_post).drop("__c")


def placebo_in_time(panel: DataFrame, treated: str, cutoff, donors: list[str] | None = None, method: str = "scm", min_pre: int = 30, every: int = 7, post_agg: str = "mean", **settings) -> dict[str, DataFrame]:
    tasks = placebo_time_tasks(panel, treated, cutoff, donors, min_pre, every)
    e = estimate(panel, tasks, method, **settings)
    n_post = e.where((F.col("task") == "true") & (F.col("date") >= F.lit(str(cutoff)).cast("date"))).count()
    seg = event_segments(e, tasks, n_post)
    f = F.avg if post_agg == "mean" else F.sum
    stat = seg.groupBy("task").agg(f("effect").alias("stat"))
    q = F.percentile("effect", [0.1, 0.9, 0.025, 0.975])
    band = seg.where("task <> 'true'").groupBy("event_time").agg(q.alias("q"), F.stddev_samp("effect").alias("std")).select("event_time", *(F.col("q")[i].alias(n) for i, n in enumerate(("p10", "p90", "ci_lo", "ci_hi"))), "std")
    return {"effects": e, "segments": seg, "p_value": placebo_p(stat, "true"), "band": band}


def effect_bands(effects: DataFrame, true: str, level: float = 0.95, method: str = "quantile", axis: str = "date", horizon: int | None = None) -> DataFrame:
    """The true effects with a band from the placebos, by date or event time; NULL where there are none."""
    from .lags import normal_quantile

    a = (1 - level) / 2
    p = effects.where(F.col("task") != true).groupBy(axis)
    if method == "quantile":
        q = p.agg(F.percentile("effect", [a, 1 - a, 0.1, 0.9]).alias("q")).select(axis, *(F.col("q")[i].alias(n) for i, n in enumerate(("low", "high", "p10", "p90"))))
    elif method == "std":
        z = normal_quantile(1 - a)
        m, s = F.col("plc_mean"), F.col("plc_std")
        q = p.agg(F.avg("effect").alias("plc_mean"), F.stddev_samp("effect").alias("plc_std")).select(axis, (m - z * s).alias("low"), (m + z * s).alias("high"), "plc_mean", "plc_std", F.lit(z).alias("z"))
    else:
        raise ConfigError("method is quantile or std")
    out = effects.where(F.col("task") == true).select(axis, "effect").join(q, axis, "left")
    return out.where(F.col(axis) < horizon) if horizon is not None else out


def bootstrap_tasks(panel: DataFrame, treated: str, cutoff, donors: list[str] | None = None, b: int = 200, donor_frac: float = 0.8, seed: int = 1) -> DataFrame:
    """Replicates with max(3, share) donors drawn without replacement."""
    mine = donors_of(panel, treated, donors)
    if len(mine) < 3:
        raise DataError("at least three donors are needed")
    k = min(len(mine), max(3, round(donor_frac * len(mine))))
    rng = np.random.default_rng(seed)
    return tasks_table(panel.sparkSession, [("true", treated, cutoff, mine), *((f"b{i}", treated, cutoff, sorted(rng.choice(mine, k, replace=False))) for i in range(b))])


def jackknife_tasks(panel: DataFrame, treated: str, cutoff, donors: list[str] | None = None) -> DataFrame:
    mine = donors_of(panel, treated, donors)
    if len(mine) < 3:
        raise DataError("at least three donors are needed")
    return tasks_table(panel.sparkSession, [("true", treated, cutoff, mine), *((f"-{d}", treated, cutoff, [u for u in mine if u != d]) for d in mine)])


def uncertainty_bands(panel: DataFrame, treated: str, cutoff, donors: list[str] | None = None, kind: str = "jackknife", method: str = "scm", b: int = 200, donor_frac: float = 0.8, time_block_days: int | None = None, level: float = 0.95, seed: int = 1, **settings) -> DataFrame:
    """(date, effect, low, high, n): bootstrap quantiles, or the jackknife's standard error over the fits that succeeded."""
    from .lags import normal_quantile

    a = (1 - level) / 2
    if kind == "bootstrap":
        tasks = bootstrap_tasks(panel, treated, cutoff, donors, b, donor_frac, seed)
        src = panel
        if time_block_days:  # moving blocks before the cutoff; membership only, replicates share the panel
            day = F.datediff("date", F.lit("1970-01-01").cast("date"))
            block = F.floor(day / time_block_days)
            t = tasks.select("task").crossJoin(panel.select("date").distinct()).where((F.col("task") == "true") | (F.col("date") >= F.lit(str(cutoff)).cast("date")) | (F.pmod(F.xxhash64("task", block, F.lit(seed)), F.lit(100)) < 63))  # replicates x dates: a bootstrap block is drawn at least once with probability 1 - 1/e
            e = estimate_on(panel, tasks, t, method, **settings)
        else:
            e = estimate(src, tasks, method, **settings)
        x = e.where("task <> 'true'").groupBy("date").agg(F.percentile("effect", [a, 1 - a]).alias("q"), F.count("effect").alias("n"))
        q = x.select("date", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "n")
        return e.where("task = 'true'").select("date", "effect").join(q, "date", "left")
    if kind != "jackknife":
        raise ConfigError("kind is bootstrap or jackknife")
    e = estimate(panel, jackknife_tasks(panel, treated, cutoff, donors), method, **settings)
    z = normal_quantile(1 - a)
    n = F.col("n")
    s = e.where("task <> 'true'").groupBy("date").agg(F.count("effect").alias("n"), F.var_pop("effect").alias("v")).select("date", "n", F.sqrt((n - 1) * F.col("v")).alias("se"))
    return e.where("task = 'true'").select("date", "effect").join(s, "date", "left").select("date", "effect", (F.col("effect") - z * F.col("se")).alias("low"), (F.col("effect") + z * F.col("se")).alias("high"), "n")


def estimate_on(panel: DataFrame, tasks: DataFrame, dates: DataFrame, method: str, **settings) -> DataFrame:
    """Estimates of tasks of which each sees only its own dates: the task's number becomes part of the units' names."""
    p = panel.join(dates, "date").withColumn("unit", F.concat_ws("\u0001", "task", "unit")).drop("task")
    t = tasks.withColumns({"treated": F.concat_ws("\u0001", "task", "treated"), "donors": F.transform("donors", lambda d: F.concat_ws("\u0001", F.col("task"), d))})
    return estimate(p, t, method, **settings)


def conformal_interval(path: DataFrame, cutoff, n_perm: int | None = 1000, level: float = 0.95, seed: int = 1) -> DataFrame:
    """One row: att, p_value, half_width, low, high, n. Null: means of contiguous windows of the post length.

    ``n_perm=None`` takes every window once; else windows are drawn by hash.
    """
    e = path.where(F.col("effect").isNotNull() & ~F.isnan("effect")).select("date", "effect")
    post = F.col("date") >= F.lit(str(cutoff)).cast("date")
    r = e.agg(F.avg(F.when(post, F.col("effect"))).alias("att"), F.count_if(post).alias("post"), F.count_if(~post).alias("pre")).first()
    if not r.post or not r.pre:
        raise DataError("effects are needed before and after the cutoff")
    w = Window.partitionBy().orderBy("date")
    x = e.withColumns({"i": F.row_number().over(w) - 1, "m": F.avg("effect").over(w.rowsBetween(0, r.post - 1))}).where(F.col("i") <= r.pre)
    if n_perm is not None:
        s = e.sparkSession.range(n_perm).select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(r.pre + 1)).alias("i"))
        x = x.join(s, "i")
    att = float(r.att)
    return x.agg(F.lit(att).alias("att"), ((F.count_if(F.abs("m") >= abs(att) - 1e-12) + 1) / (F.count("*") + 1)).alias("p_value"), F.percentile(F.abs("m"), level).alias("half_width"), F.count("*").alias("n")).select("att", "p_value", "half_width", (F.col("att") - F.col("half_width")).alias("low"), (F.col("att") + F.col("half_width")).alias("high"), "n")


def rmspe_ratios(effects: DataFrame, cutoff) -> DataFrame:
    """(task, pre_rmspe, post_rmspe, ratio)."""
    post = F.col("date") >= F.lit(str(cutoff)).cast("date")
    sq = F.when(~F.isnan("effect"), F.col("effect") * F.col("effect"))
    x = effects.groupBy("task").agg(F.sqrt(F.avg(F.when(~post, sq))).alias("pre_rmspe"), F.sqrt(F.avg(F.when(post, sq))).alias("post_rmspe"))
    return x.withColumn("ratio", ratio(F.col("post_rmspe"), F.col("pre_rmspe")))


def rmspe_ratio_test(effects: DataFrame, cutoff, true: str) -> DataFrame:
    """One row: ratio, p_value, rank (1 + larger placebo ratios), n."""
    r = rmspe_ratios(effects, cutoff)
    t = r.where(F.col("task") == true).select(F.col("ratio").alias("t"))
    x = r.where((F.col("task") != true) & F.col("ratio").isNotNull()).crossJoin(F.broadcast(t))  # one row
    return x.agg(F.first("t").alias("ratio"), ((F.count_if(F.col("ratio") >= F.col("t")) + 1) / (F.count("*") + 1)).alias("p_value"), (F.count_if(F.col("ratio") > F.col("t")) + 1).alias("rank"), F.count("*").alias("n"))


def scm_diagnostics(path: DataFrame, cutoff) -> DataFrame:
    """One row of fit and effect figures."""
    post = F.col("date") >= F.lit(str(cutoff)).cast("date")
    ok = F.col("effect").isNotNull() & ~F.isnan("effect")
    e, o = F.when(ok, F.col("effect")), F.when(ok, F.col("observed"))
    pe, po = F.when(~post, e), F.when(~post, o)
    a = path.agg(F.sqrt(F.avg(pe * pe)).alias("pre_rmse"), F.avg(F.abs(pe)).alias("pre_mae"), F.avg(F.when(F.abs(po) > 1e-12, F.abs(pe / F.when(po != 0, po)))).alias("pre_mape"), (1 - ratio(F.sum(pe * pe), F.var_pop(po) * F.count(po))).alias("pre_r2"), F.avg(F.when(post, e)).alias("att"), F.sum(F.when(post, e)).alias("cumulative"), F.sqrt(F.avg(F.when(post, e * e))).alias("post_rmse"))
    return a


def weight_diagnostics(w: DataFrame, top_k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(one row: hhi, effective_n), and the top donors by absolute weight with their share."""
    ok = w.where(F.col("weight").isNotNull() & ~F.isnan("weight"))
    one = ok.agg(F.sum(F.col("weight") * F.col("weight")).alias("hhi"), F.sum(F.abs("weight")).alias("total"))
    top = ok.orderBy(F.desc(F.abs("weight")), "donor").limit(top_k).crossJoin(F.broadcast(one)).select("donor", "weight", ratio(F.abs("weight"), F.col("total")).alias("share"))  # one row
    return one.select("hhi", ratio(F.lit(1.0), F.col("hhi")).alias("effective_n")), top


def loo_weight_stability(panel: DataFrame, treated: str, cutoff, donors: list[str] | None = None, drop: list[str] | None = None, method: str = "scm", **settings) -> DataFrame:
    """(dropped, mean_drift, max_drift, att_shift) for each donor left out."""
    mine = donors_of(panel, treated, donors)
    out = [d for d in (drop or mine) if d in mine and len(mine) > 2]
    tasks = tasks_table(panel.sparkSession, [("true", treated, cutoff, mine), *((d, treated, cutoff, [u for u in mine if u != d]) for d in out)])
    fits = run_tasks(panel, tasks, method, **settings)
    w, att = weights(fits), post_statistic(paths(fits), cutoff)
    base = w.where("task = 'true'").select("donor", F.col("weight").alias("w0"))
    drift = w.where("task <> 'true'").join(base, "donor").groupBy("task").agg(F.avg(F.abs(F.col("weight") - F.col("w0"))).alias("mean_drift"), F.max(F.abs(F.col("weight") - F.col("w0"))).alias("max_drift"))
    t = att.where("task = 'true'").select(F.col("stat").alias("s0"))
    return drift.join(att, "task").crossJoin(F.broadcast(t)).select(F.col("task").alias("dropped"), "mean_drift", "max_drift", (F.col("stat") - F.col("s0")).alias("att_shift"))  # one row
