"""Small dense solvers of synthetic-control estimators, on one treated unit's block (NumPy only)."""

from __future__ import annotations

import numpy as np

LAMBDAS = np.arange(0.1, 10.0001, 0.1)


def project_simplex(v: np.ndarray) -> np.ndarray:
    """Nearest point with non-negative entries that sum to 1."""
    u = np.sort(v)[::-1]
    c = (np.cumsum(u) - 1) / np.arange(1, len(v) + 1)
    k = np.flatnonzero(u > c)[-1]
    return np.maximum(v - c[k], 0)


def simplex_ls(y: np.ndarray, x: np.ndarray, ridge: float = 1e-8, steps: int = 5000) -> np.ndarray:
    """Weights on the simplex with least squared error, by accelerated projected gradients."""
    j = x.shape[1]
    g = x.T @ x + ridge * np.eye(j)
    b = x.T @ y
    size = 1.0 / max(np.linalg.eigvalsh(g)[-1], 1e-12)
    w = z = np.full(j, 1.0 / j)
    t = 1.0
    for _ in range(steps):
        new = project_simplex(z - size * (g @ z - b))
        if (z - new) @ (new - w) > 0:  # restart when momentum points uphill
            t, z = 1.0, w
            new = project_simplex(z - size * (g @ z - b))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t2 * (new - w)
        done = np.abs(new - w).max() < 1e-12
        w, t = new, t2
        if done:
            break
    return w


def affine_ls(y: np.ndarray, x: np.ndarray, ridge: float = 1e-8) -> np.ndarray:
    """Weights of any sign that sum to 1, with least squared error."""
    j = x.shape[1]
    k = np.zeros((j + 1, j + 1))
    k[:j, :j] = x.T @ x + ridge * np.eye(j)
    k[:j, j] = k[j, :j] = 1
    return np.linalg.lstsq(k, np.append(x.T @ y, 1.0), rcond=None)[0][:j]


def ridge_loo(f: np.ndarray, y: np.ndarray, lambdas: np.ndarray = LAMBDAS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge of every column of y (donors x periods) on standardised features; lambda by leave-one-out.

    One SVD of the shared features serves all periods. Returns intercepts, coefficients, lambdas; the
    objective is squared error / (2n) + lambda / 2 * |b|^2.
    """
    n = len(f)
    y0 = y.mean(axis=0)
    u, s, vt = np.linalg.svd(f, full_matrices=False)
    uy = u.T @ (y - y0)
    best = np.full(y.shape[1], np.inf)
    lam = np.full(y.shape[1], lambdas[0])
    for a in lambdas:
        d = s**2 / (s**2 + n * a)
        hat = (u**2 * d).sum(axis=1) + 1.0 / n
        res = (y - y0 - u @ (d[:, None] * uy)) / np.maximum(1 - hat, 1e-9)[:, None]
        err = (res**2).mean(axis=0)
        better = err < best
        best[better], lam[better] = err[better], a
    coef = vt.T @ ((s[:, None] / (s[:, None] ** 2 + n * lam[None, :])) * uy)
    return y0, coef, lam


def fit_scm(y: np.ndarray, x: np.ndarray, pre: np.ndarray, covariates: np.ndarray | None = None, allow_negative: bool = False, lambdas: np.ndarray = LAMBDAS) -> dict:
    """Augmented ridge synthetic control of one treated series y (T) and donors x (T x J)."""
    ok = np.isfinite(x[pre]).all(axis=0)
    if not np.isfinite(y[pre]).all():
        raise ValueError("the treated unit has gaps before the cutoff")
    if ok.sum() < 1:
        raise ValueError("no complete donors")
    xs = x[:, ok]
    feats = np.vstack([xs[pre], covariates[1:, :][ok].T] if covariates is not None else [xs[pre]]).T
    mine = np.concatenate([y[pre], covariates[0]]) if covariates is not None else y[pre]
    mu, sd = feats.mean(axis=0), feats.std(axis=0)
    sd = np.where(sd > 1e-12, sd, 1.0)
    f, f0 = (feats - mu) / sd, (mine - mu) / sd
    t, j = len(y), xs.shape[1]
    m_t, m_d, alpha = np.zeros(t), np.zeros((t, j)), np.full(t, np.nan)
    full = np.isfinite(xs).all(axis=1)
    for rows in [np.flatnonzero(full), *([[r]] for r in np.flatnonzero(~full))] if not full.all() else [np.arange(t)]:
        rows = np.asarray(rows).reshape(-1)
        for part in [rows] if full[rows].all() else [[r] for r in rows]:
            part = np.asarray(part)
            have = np.isfinite(xs[part[0]]) if not full[part].all() else np.ones(j, bool)
            if have.sum() < 3:
                m_t[part] = np.nanmean(xs[part], axis=1) if have.any() else np.nan
                m_d[part] = m_t[part][:, None]
                continue
            y0, coef, lam = ridge_loo(f[have], xs[part][:, have].T, lambdas)
            m_t[part] = y0 + f0 @ coef
            m_d[part] = (y0 + f @ coef).T
            alpha[part] = lam
    res_t, res_d = y - m_t, xs - m_d
    solve = affine_ls if allow_negative else simplex_ls
    w = solve(res_t[pre], res_d[pre])
    if not allow_negative:
        w = np.clip(w, 0, None)
        w = w / w.sum() if w.sum() > 0 else np.full(j, 1 / j)
    synthetic = m_t + np.where(np.isfinite(res_d), res_d, 0.0) @ w
    weights = np.zeros(x.shape[1])
    weights[ok] = w
    return {"synthetic": synthetic, "weights": weights, "alpha": alpha}


def blend(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted mean of the donors present in each period; NaN where none with weight is."""
    have = np.isfinite(x)
    total = have @ w
    return np.where(total > 1e-12, np.where(have, x, 0.0) @ w / np.where(total > 1e-12, total, 1.0), np.nan)


def fit_abadie(y: np.ndarray, x: np.ndarray, pre: np.ndarray) -> dict:
    rows = pre & np.isfinite(y) & np.isfinite(x).all(axis=1)
    j = x.shape[1]
    w = simplex_ls(y[rows], x[rows]) if rows.any() else np.full(j, 1 / j)
    return {"synthetic": blend(x, w), "weights": w}


def fit_did(y: np.ndarray, x: np.ndarray, pre: np.ndarray) -> dict:
    d = np.nanmean(x, axis=1)
    return {"synthetic": np.nanmean(y[pre]) + d - np.nanmean(d[pre]), "weights": np.full(x.shape[1], 1 / x.shape[1])}


def fit_mcnnm(y: np.ndarray, x: np.ndarray, pre: np.ndarray, lam: float | None = None, max_iter: int = 300, tol: float = 1e-5, unit_fe: bool = True, time_fe: bool = True) -> dict:
    """Matrix completion with a nuclear norm: block updates of fixed effects and a soft-thresholded SVD."""
    full = np.column_stack([y, x])
    seen = np.isfinite(full)
    seen[~pre, 0] = False
    data = np.where(seen, full, 0.0)
    low, a, b = np.zeros_like(full), np.zeros((1, full.shape[1])), np.zeros((len(full), 1))
    lam = 0.1 * np.linalg.norm(data - data.sum() / max(seen.sum(), 1), 2) if lam is None else lam
    before = np.inf
    for _ in range(max_iter):
        if unit_fe:
            a = (np.where(seen, data - low - b, 0).sum(axis=0) / np.maximum(seen.sum(axis=0), 1))[None, :]
        if time_fe:
            b = (np.where(seen, data - low - a, 0).sum(axis=1) / np.maximum(seen.sum(axis=1), 1))[:, None]
        u, s, vt = np.linalg.svd(np.where(seen, data - a - b, low), full_matrices=False)
        low = (u * np.maximum(s - lam, 0)) @ vt
        now = np.linalg.norm(np.where(seen, data - a - b - low, 0))
        if abs(before - now) <= tol * max(before, 1e-12):
            break
        before = now
    return {"synthetic": (low + a + b)[:, 0], "weights": np.full(x.shape[1], np.nan)}


def fit_robust(y: np.ndarray, x: np.ndarray, pre: np.ndarray, rank: int | None = None, energy: float = 0.95, alpha: float = 0.0, rescale: bool = True) -> dict:
    """Donors denoised by a truncated SVD, then least squares (or ridge) with an intercept."""
    seen = np.isfinite(x)
    mu = np.nanmean(x, axis=0)
    z = np.where(seen, x - mu, 0.0)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    if rank is None:
        share = np.cumsum(s**2) / max((s**2).sum(), 1e-300)
        rank = int(np.searchsorted(share, energy) + 1)
    k = max(1, min(rank, len(s)))
    den = (u[:, :k] * s[:k]) @ vt[:k]
    if rescale:
        den = den / max(seen.mean(), 1e-12)
    den = den + mu
    rows = pre & np.isfinite(y)
    m, c = den[rows].mean(axis=0), y[rows].mean()
    a = den[rows] - m
    w = np.linalg.solve(a.T @ a + alpha * np.eye(x.shape[1]), a.T @ (y[rows] - c)) if alpha > 0 else np.linalg.pinv(a, rcond=1e-10) @ (y[rows] - c)
    intercept = c - m @ w
    return {"synthetic": intercept + den @ w, "weights": w, "rank": k, "intercept": float(intercept)}


def log_dirichlet(x: np.ndarray, a: np.ndarray) -> float:
    from math import lgamma

    return lgamma(a.sum()) - sum(map(lgamma, a)) + float(((a - 1) * np.log(x + 1e-12)).sum())


def fit_bayes(y: np.ndarray, x: np.ndarray, pre: np.ndarray, concentration: float = 1.0, sigma_prior: float = 1.0, draws: int = 2000, burnin: int = 1000, level: float = 0.95, seed: int = 1) -> dict:
    """Metropolis-Hastings over simplex weights and noise."""
    rng = np.random.default_rng(seed)
    rows = pre & np.isfinite(y) & np.isfinite(x).all(axis=1)
    if rows.sum() < 5:
        raise ValueError("fewer than five complete periods before the cutoff")
    yy, xx, j = y[rows], x[rows], x.shape[1]
    prior = np.full(j, concentration)

    def posterior(w, s):
        r = yy - xx @ w
        return -len(yy) * np.log(s) - (r @ r) / (2 * s * s) + log_dirichlet(w, prior) - s * s / (2 * sigma_prior**2)

    w, sigma, scale, hits = np.full(j, 1 / j), max(float(np.std(yy - xx.mean(axis=1))), 1e-3), 30.0 * j, 0
    now = posterior(w, sigma)
    kept_w, kept_s = [], []
    for i in range(draws + burnin):
        a = w * scale + 1e-6
        new = rng.gamma(np.maximum(a, 1e-3))
        new = new / max(new.sum(), 1e-300)
        s2 = abs(sigma + rng.normal(0, 0.1))
        there = posterior(new, max(s2, 1e-6))
        ratio = there - now + log_dirichlet(w, new * scale + 1e-6) - log_dirichlet(new, a)
        if np.log(rng.uniform()) < ratio:
            w, sigma, now, hits = new, max(s2, 1e-6), there, hits + 1
        if (i + 1) % 50 == 0 and i < burnin:
            rate, hits = hits / 50, 0
            scale *= 1.25 if rate < 0.15 else 0.8 if rate > 0.4 else 1.0
        if i >= burnin:
            kept_w.append(w)
            kept_s.append(blend(x, w))
    s = np.array(kept_s)
    lo, hi = np.quantile(s, [(1 - level) / 2, (1 + level) / 2], axis=0)
    ws = np.array(kept_w)
    return {"synthetic": s.mean(axis=0), "weights": ws.mean(axis=0), "synthetic_low": lo, "synthetic_high": hi, "weights_low": np.quantile(ws, (1 - level) / 2, axis=0), "weights_high": np.quantile(ws, (1 + level) / 2, axis=0)}


def fit_ml(y: np.ndarray, x: np.ndarray, pre: np.ndarray, rounds: int = 60, step: float = 0.1, depth: int = 2) -> dict:
    """Boosted regression trees on the donors' values, fitted before the cutoff."""
    rows = np.flatnonzero(pre & np.isfinite(y))
    if len(rows) < 3:
        raise ValueError("fewer than three periods before the cutoff")
    z = np.where(np.isfinite(x), x, np.nanmean(x, axis=0))
    base = y[rows].mean()
    out, res = np.full(len(y), base), y[rows] - base

    def grow(at: np.ndarray, every: np.ndarray, r: np.ndarray, left: int) -> np.ndarray:
        value = np.full(len(every), r.mean() if len(r) else 0.0)
        if left == 0 or len(at) < 6:
            return value
        best = (((r - r.mean()) ** 2).sum(), None, None)
        for f in range(z.shape[1]):
            for c in np.unique(np.quantile(z[at, f], np.linspace(0.1, 0.9, 9))):
                m = z[at, f] <= c
                if 3 <= m.sum() <= len(at) - 3:
                    e = ((r[m] - r[m].mean()) ** 2).sum() + ((r[~m] - r[~m].mean()) ** 2).sum()
                    if e < best[0] - 1e-12:
                        best = (e, f, c)
        if best[1] is None:
            return value
        m, k = z[at, best[1]] <= best[2], z[every, best[1]] <= best[2]
        value[k] = grow(at[m], every[k], r[m], left - 1)
        value[~k] = grow(at[~m], every[~k], r[~m], left - 1)
        return value

    every = np.arange(len(y))
    for _ in range(rounds):
        p = grow(rows, every, res, depth)
        out += step * p
        res = res - step * p[rows]
    return {"synthetic": out, "weights": np.full(x.shape[1], np.nan)}


FITS = {"scm": fit_scm, "abadie": fit_abadie, "did": fit_did, "mcnnm": fit_mcnnm, "robust": fit_robust, "bayes": fit_bayes, "mlscm": fit_ml}
