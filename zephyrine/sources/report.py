"""Reports of runs, and tidy tables behind the usual plots."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models.explain import axis_rank
from ..operators.metrics import polar_bins, resample_mean
from ..schema import col, numeric_columns

KEYS = ("kind", "time", "seed", "python", "spark", "host", "user", "rows", "data_hash", "config_hash")
PREVIEW = 12


def cell(x) -> str:
    return f"{x:.4g}" if isinstance(x, float) else "" if x is None else str(x)


def plot_kind(columns: list[str]) -> str | None:
    """Which plot a result's columns call for."""
    c = set(columns)
    if {"observed", "normalised"} <= c:
        return "normalise"
    if {"synthetic", "effect"} <= c:
        return "scm"
    if "emi_total" in c:
        return "decomposition"
    return "cv" if {"fold", "RMSE"} <= c else None


def generate_html(run, title: str = "Run") -> str:
    """Keys, the first rows at four digits, provenance."""
    rows = run.result.limit(PREVIEW).collect()
    esc = html.escape
    head = "".join(f"<tr><th>{esc(k)}</th><td>{esc(cell(run.metadata.get(k)))}</td></tr>" for k in KEYS)
    table = "<tr>" + "".join(f"<th>{esc(c)}</th>" for c in run.result.columns) + "</tr>" + "".join("<tr>" + "".join(f"<td>{esc(cell(v))}</td>" for v in r) + "</tr>" for r in rows)
    model = f"<h2>Model</h2><p>{esc(run.model.backend)}: {esc(', '.join(run.model.features))}</p>" if run.model is not None else ""
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{esc(title)}</title></head><body><h1>{esc(title)}</h1><table>{head}</table><p>Plot: {esc(plot_kind(run.result.columns) or 'none')}</p><h2>Result</h2><table>{table}</table>{model}<h2>Provenance</h2><pre>{esc(json.dumps(run.metadata, indent=1, default=str))}</pre></body></html>"


def to_markdown(run, title: str = "Run") -> str:
    rows = run.result.limit(PREVIEW).collect()
    cols = run.result.columns
    lines = [f"# {title}", "", *(f"- **{k}**: {cell(run.metadata.get(k))}" for k in KEYS), "", "| " + " | ".join(cols) + " |", "|" + "-|" * len(cols)]
    lines += ["| " + " | ".join(cell(v).replace("|", "\\|") for v in r) + " |" for r in rows]
    return "\n".join(lines) + "\n"


def time_series_data(df: DataFrame, unit: str | None = None, date: str = "date") -> DataFrame:
    """(date, series, value) of all numeric columns, resampled if asked."""
    x = resample_mean(df, unit, date) if unit else df
    names = [c for c in numeric_columns(x) if c != date]
    return x.select(col(date), *(col(c).cast("double").alias(c) for c in names)).unpivot(date, names, "series", "value")


def decomposition_data(df: DataFrame, date: str = "date") -> DataFrame:
    """(date, component, value) without totals and bases."""
    skip = {"observed", "model_pred", "residual", "emi_base", "met_base", "emi_total", "met_total"}
    names = [c for c in numeric_columns(df) if c not in skip and c != date]
    return df.unpivot(date, names, "component", "value")


def pdp_data(pdp: DataFrame) -> DataFrame:
    """The PDP in axis order, with a ribbon of one standard deviation."""
    return pdp.withColumns({"low": F.col("pdp_mean") - F.col("pdp_std"), "high": F.col("pdp_mean") + F.col("pdp_std")}).orderBy("variable", axis_rank(F.col("value")))


def polar_data(df: DataFrame, value: str, speed: str, direction: str, **kw) -> DataFrame:
    return polar_bins(df, value, speed, direction, **kw)


def scm_dashboard_data(path: DataFrame, weights: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """The path in time order, and the donors with the largest weights."""
    return path.orderBy("date"), weights.where(F.col("weight").isNotNull()).orderBy(F.desc(F.abs("weight")), "donor").limit(k)


def band_data(bands: DataFrame) -> DataFrame:
    """(x, effect, low, high) from lower/upper or low/high, by date or event time."""
    c = set(bands.columns)
    x = "date" if "date" in c else "event_time"
    return bands.select(col(x).alias("x"), "effect", col("low" if "low" in c else "lower").alias("low"), col("high" if "high" in c else "upper").alias("high")).orderBy("x")
