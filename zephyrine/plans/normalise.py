"""Normalisation: replace covariates by rows drawn from a pool many times, predict, average by date.

The plan of all variants is one job: rows x samples (an array exploded, no shuffle), an index
computed from (row, sample, seed), an equi-join to the pool on its dense index, the model, and one
aggregate by date, whose partial sums shrink n x S rows to n before the shuffle. The pool is narrowed to
the resampled columns, and broadcast only if its rows times columns stay under
BROADCAST_CELLS; beyond, the join shuffles by pool index.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigError, DataError, get_logger
from ..operators.index import with_index
from ..operators.prepare import add_date_variables, conditional_filter, portable_hash
from ..schema import TIME_VARS, col, percent, quantile_name, require_columns

BROADCAST_CELLS = 2_000_000
INDEXES = ("portable", "exhaustive", "hash")


def draw(i: Column, s: Column, m: Column, seed: int, index: str) -> Column:
    """The pool row of (row, sample)."""
    if index == "exhaustive":
        return F.pmod(i + s, m)
    if index == "hash":
        return F.pmod(F.xxhash64(i, s, F.lit(seed)), m)
    return F.shiftright(portable_hash(i, s, seed) * m, 31)


def with_time_vars(df: DataFrame, names: list[str]) -> DataFrame:
    return add_date_variables(df) if set(names) & set(TIME_VARS) - set(df.columns) else df


def indexed_pool(pool: DataFrame, names: list[str]) -> tuple[DataFrame, int]:
    """The pool's resampled columns as p_<name>, with the dense index k, and its number of rows."""
    require_columns(pool, *names)
    m = pool.count()
    if not m:
        raise DataError("the pool is empty")
    order = [c for c in ("date", *names) if c in pool.columns]
    out = with_index(pool.select(*map(col, dict.fromkeys(order))), order, "k", rows=m)
    out = out.select("k", *(col(n).alias(f"p_{n}") for n in names))
    return (F.broadcast(out) if m * (len(names) + 1) <= BROADCAST_CELLS else out), m


def base_rows(df: DataFrame, model, rows: int | None = None) -> DataFrame:
    """Date, observation, features and the dense index i."""
    keep = list(dict.fromkeys(["date", "value", *model.features]))
    require_columns(df, *keep)
    return with_index(df.select(*map(col, keep)), ["date", "value"], "i", rows=rows)


def resample(df: DataFrame, names: list[str], seed: int = 1, replace: bool = True, pool: DataFrame | None = None) -> DataFrame:
    """``df`` with the named columns drawn jointly from the pool, and ``seed``."""
    p, m = indexed_pool(df if pool is None else pool, names)
    base = with_index(df, ["date"], "i")
    if replace:
        k = draw(F.col("i"), F.lit(0).cast("long"), F.lit(m).cast("long"), seed, "portable")
    else:
        if df.count() > m:
            raise DataError("the pool has too few rows to draw without replacement")
        p = with_index(p.withColumn("__h", portable_hash(F.col("k"), 0, seed)).drop("k"), ["__h"], "k", rows=m).drop("__h")
        k = F.col("i")
    out = base.withColumn("k", k).join(p, "k")
    return out.select(*(col(f"p_{c}").alias(c) if c in names else col(c) for c in df.columns), F.lit(seed).alias("seed"))


def sampled(base: DataFrame, pool: DataFrame, m: int, names: list[str], n_samples: int, seed: int, index: str, frozen: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows x samples (x states) with drawn covariates; ``frozen`` maps a state to the columns it keeps."""
    if index not in INDEXES:
        raise ConfigError(f"unknown index {index}")
    n = m if index == "exhaustive" else n_samples
    x = base.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    x = x.withColumn("k", draw(F.col("i"), F.col("s"), F.lit(m).cast("long"), seed, index)).join(pool, "k")
    if frozen is None:
        return x.withColumns({c: col(f"p_{c}") for c in names}).drop(*(f"p_{c}" for c in names))
    x = x.withColumn("state", F.explode(F.array(*map(F.lit, frozen))))
    new = {c: F.when(F.col("state").isin([s for s, keep in frozen.items() if c in keep]), col(c)).otherwise(col(f"p_{c}")) for c in names}
    return x.withColumns(new).drop(*(f"p_{c}" for c in names))


def resample_vars_of(model, names: list[str] | None) -> list[str]:
    return list(names) if names is not None else [f for f in model.features if f not in TIME_VARS]


def normalise(df: DataFrame, model, resample_vars: list[str] | None = None, n_samples: int = 300, seed: int = 7_654_321, pool: DataFrame | None = None, aggregate: bool = True, quantiles: list[float] | None = None, conditional_on: dict | None = None, index: str = "portable") -> DataFrame:
    """(date, observed, normalised[, qNNN...]), or with ``aggregate=False`` the long form with the sample ``s``."""
    names = resample_vars_of(model, resample_vars)
    df = with_time_vars(df, model.features)
    source = with_time_vars(df if pool is None else pool, names)
    if conditional_on:
        source = conditional_filter(source, conditional_on)
    p, m = indexed_pool(source, names)
    x = model.transform(sampled(base_rows(df, model), p, m, names, n_samples, seed, index))
    if not aggregate:
        return x.select("date", F.col("value").alias("observed"), "s", F.col("prediction").alias("normalised"))
    out = [F.avg("value").alias("observed"), F.avg("prediction").alias("normalised")]
    if quantiles:
        out.append(F.percentile("prediction", [float(q) for q in quantiles]).alias("__q"))
    r = x.groupBy("date").agg(*out)
    if quantiles:
        r = r.select("date", "observed", "normalised", *(F.col("__q")[i].alias(quantile_name(q)) for i, q in enumerate(quantiles)))
    return r


def wide(long: DataFrame, n_samples: int) -> DataFrame:
    """The long form with one column a sample (explicit values, so no extra job)."""
    return long.groupBy("date", "observed").pivot("s", list(range(n_samples))).agg(F.avg("normalised"))


def write_batches(df: DataFrame, model, path: str, n_samples: int, batch: int = 100, fmt: str = "parquet", **kw) -> DataFrame:
    """The long form on disk, partitioned by batch of samples; returns the table read back."""
    if fmt not in ("parquet", "csv"):
        raise ConfigError("fmt is parquet or csv")
    long = normalise(df, model, n_samples=n_samples, aggregate=False, **kw).withColumn("batch", F.floor(F.col("s") / batch).cast("int"))
    w = long.write.mode("overwrite").partitionBy("batch")
    w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path)
    return df.sparkSession.read.schema(long.schema).option("header", fmt == "csv").format(fmt).load(path)


@dataclass
class AutoResult:
    best_n: int
    result: DataFrame
    history: list[tuple[int, float]]
    converged: bool


def normalise_auto(df: DataFrame, model, resample_vars: list[str] | None = None, pool: DataFrame | None = None, metric: str = "series", tol: str | float | None = None, rse_percentile: float = 0.95, streak: int | None = None, batch_size: int = 100, max_samples: int = 5000, seed: int = 7_654_321, index: str = "portable", normaliser: Callable[[int, int], DataFrame] | None = None) -> AutoResult:
    """Batches of samples until the series (or its grand mean) is steady.

    Per date the sums and squared sums of the batch means are kept in a small table (a row for each
    date), checkpointed every batch, so that a step's plan doesn't hold all steps before.
    ``normaliser(n, seed)`` may stand in for ``normalise``.
    """
    if metric not in ("series", "global"):
        raise ConfigError("metric is series or global")
    limit = percent(tol) if tol is not None else 0.03 if metric == "series" else 0.005
    need = streak or (3 if metric == "series" else 5)
    run = normaliser or (lambda n, s: normalise(df, model, resample_vars, n, s, pool, index=index))
    acc, history, total, batches, steady, last = None, [], 0, 0, 0, None
    while total < max_samples and steady < need:
        now = run(batch_size, seed + total).select("date", F.col("observed"), F.col("normalised").alias("m"))
        now = now.select("date", "observed", "m", (F.col("m") * F.col("m")).alias("m2"))
        acc = now if acc is None else acc.unionByName(now).groupBy("date").agg(F.first("observed").alias("observed"), F.sum("m").alias("m"), F.sum("m2").alias("m2"))
        acc = _cut(acc)
        total, batches = total + batch_size, batches + 1
        if metric == "series":
            if batches > 1:
                mean = F.col("m") / batches
                var = F.greatest((F.col("m2") - F.col("m") * mean) / (batches - 1), F.lit(0.0))
                rse = F.when(F.abs(mean) > 1e-12, F.sqrt(var / batches) / F.abs(mean))
                v = acc.agg(F.percentile(rse, rse_percentile)).first()[0] or 0.0
                history.append((total, float(v)))
                steady = steady + 1 if v < limit else 0
        else:
            grand = acc.agg(F.avg(F.col("m") / batches)).first()[0]
            if last is not None:
                v = abs(grand - last) / max(abs(last), 1e-12)
                history.append((total, float(v)))
                steady = steady + 1 if v < limit else 0
            last = grand
    if steady < need:
        get_logger("normalise").warning("not steady after %d samples", total)
    return AutoResult(total, acc.select("date", "observed", (F.col("m") / batches).alias("normalised")), history, steady >= need)


def _cut(df: DataFrame) -> DataFrame:
    """Lineage cut by a checkpoint in the folder the session names; local tests may have none."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if root is None:
            if not sc.master.startswith("local"):
                raise ConfigError("set spark.checkpoint.dir to a shared folder")
            import tempfile

            root = tempfile.mkdtemp()
        sc.setCheckpointDir(root)
    return df.checkpoint()


def windows(df: DataFrame, window_days: int, every: int) -> DataFrame:
    """(w, start, end): windows [start, start + days), from the first date on; a row for each window."""
    r = df.agg(F.min(F.col("date").cast("date")).alias("lo"), F.max(F.col("date").cast("date")).alias("hi")).first()
    spark = df.sparkSession
    if r.lo is None or (r.hi - r.lo).days < window_days:
        return spark.createDataFrame([], "w int, start date, end date")
    n = ((r.hi - r.lo).days - window_days) // every + 1
    return spark.range(n).select((F.col("id") + 1).cast("int").alias("w"), F.expr(f"date_add(date'{r.lo}', cast(id * {every} as int))").alias("start"), F.expr(f"date_add(date'{r.lo}', cast(id * {every} + {window_days} as int))").alias("end"))


def normalise_rolling(df: DataFrame, model, resample_vars: list[str] | None = None, pool: DataFrame | None = None, n_samples: int = 300, window_days: int = 14, every: int = 7, seed: int = 7_654_321) -> DataFrame:
    """(date, w, normalised): every window normalised with the rows of its own (or a given pool), in one job.

    A row meets its windows by arithmetic on its date, not by a range join; pool rows are numbered in
    their window, and the join is on (window, index).
    """
    names = resample_vars_of(model, resample_vars)
    df = with_time_vars(df, model.features)
    r = df.agg(F.min(F.col("date").cast("date")).alias("lo"), F.max(F.col("date").cast("date")).alias("hi")).first()
    keep = list(dict.fromkeys(["date", "value", *model.features]))
    if r.lo is None or (r.hi - r.lo).days < window_days:
        return df.select("date", F.lit(0).alias("w"), F.lit(0.0).alias("normalised")).limit(0)
    last = ((r.hi - r.lo).days - window_days) // every
    day = F.datediff(F.col("date").cast("date"), F.lit(r.lo))
    first = F.greatest(F.ceil((day - window_days + 1) / F.lit(every)), F.lit(0)).cast("int")
    until = F.least(F.floor(day / F.lit(every)), F.lit(last)).cast("int")
    x = df.select(*map(col, keep)).withColumn("w", F.explode(F.when(until >= first, F.sequence(first, until)).otherwise(F.array().cast("array<int>"))))
    x = x.withColumn("i", (F.row_number().over(Window.partitionBy("w").orderBy("date", "value")) - 1).cast("long"))
    if pool is None:
        p = x.select("w", F.col("i").alias("k"), *(col(c).alias(f"p_{c}") for c in names))
        size = p.groupBy("w").agg(F.count("*").alias("m"))
        base = x.join(F.broadcast(size), "w")  # a row for each window
    else:
        p, m = indexed_pool(with_time_vars(pool, names), names)
        base = x.withColumn("m", F.lit(m).cast("long"))
    s = base.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_samples - 1).cast("long"))))
    # The window's number moves the seed, as separate runs would.
    s = s.withColumn("k", F.shiftright(portable_hash(F.col("i"), F.col("s") + (F.col("w") + 1) * 1_000_000, seed) * F.col("m"), 31))
    drawn = s.join(p, ["w", "k"] if pool is None else ["k"])
    drawn = drawn.withColumns({c: col(f"p_{c}") for c in names}).drop(*(f"p_{c}" for c in names))
    return model.transform(drawn).groupBy("date", (F.col("w") + 1).alias("w")).agg(F.avg("prediction").alias("normalised"))


def rolling_wide(long: DataFrame, n_windows: int) -> DataFrame:
    """Windows as columns window_<zero-padded number>."""
    width = len(str(n_windows))
    out = long.groupBy("date").pivot("w", list(range(1, n_windows + 1))).agg(F.avg("normalised"))
    return out.withColumnsRenamed({str(i): f"window_{i:0{width}d}" for i in range(1, n_windows + 1)})


def multiscale(df: DataFrame, model, scales: tuple[int, ...] = (14, 90, 365), n_samples: int = 100, seed: int = 7_654_321, resample_vars: list[str] | None = None) -> DataFrame:
    """Differences of rolling normalisations of growing width and the overall one, on common dates."""
    out = None
    for d in scales:
        y = normalise_rolling(df, model, resample_vars, None, n_samples, d, max(1, d // 4), seed).groupBy("date").agg(F.avg("normalised").alias(f"y_{d}"))
        out = y if out is None else out.join(y, "date")
    out = out.join(normalise(df, model, resample_vars, n_samples, seed).select("date", F.col("normalised").alias("y_inf")), "date")
    names = ["fast", "meso", "slow"]
    steps = [f"y_{d}" for d in scales] + ["y_inf"]
    return out.select("date", *(( F.col(a) - F.col(b)).alias(f"d_{names[i] if i < len(names) else i}") for i, (a, b) in enumerate(zip(steps, steps[1:], strict=False))), "y_inf")
