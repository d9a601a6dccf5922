"""ARMA and once-differenced ARMA models without constant, fitted by likelihood for many series at once.

The likelihood comes from a state-space filter: a missing value is predicted over and
adds nothing, and the shock variance is concentrated out. Coefficients are kept
stationary and invertible by writing them through partial correlations, tanh of a free
number each. A quasi-Newton search with numerical gradients moves all series together, from
the better of a two-step least-squares estimate and no correlation.

Series are rows of a matrix, NaN where nothing was observed.
"""

from __future__ import annotations

import numpy as np

#: Free numbers stay within this, so partial correlations below 0.99999; the longest step of a search.
LIMIT, STRIDE = 6.0, 2.0
#: Variance of the unknown level of a differenced model, in shock variances.
DIFFUSE = 1e7
#: Rounds of the search, halvings of a step, half-width of a gradient, and the gain a value at which it ends.
ROUNDS, HALVINGS, WIDTH, LEAST = 60, 14, 1e-5, 1e-9


def _lagged(x: np.ndarray, lags: int) -> np.ndarray:
    return np.column_stack([np.r_[np.full(k, np.nan), x[: len(x) - k]] for k in range(1, lags + 1)])


def _least_squares(y: np.ndarray, x: np.ndarray) -> np.ndarray | None:
    whole = np.isfinite(y) & np.isfinite(x).all(axis=1)
    if whole.sum() < x.shape[1] + 2:
        return None
    coef, _, rank, _ = np.linalg.lstsq(x[whole], y[whole], rcond=None)
    return coef if rank == x.shape[1] else None


def two_step(series: np.ndarray, order: tuple[int, int, int]) -> np.ndarray | None:
    """Two-step least squares (Hannan-Rissanen) of one series: AR coefficients, then MA coefficients."""
    p, d, q = order
    w = np.diff(series) if d else series
    if q == 0:
        return _least_squares(w, _lagged(w, p))
    # The long autoregression has two lags more than the model; a series too short for it has no estimate.
    long = _lagged(w, p + q + 2)
    first = _least_squares(w, long)
    if first is None:
        return None
    shocks = w - long @ first
    return _least_squares(w, np.hstack([_lagged(w, p), _lagged(shocks, q)]))


def coefficients(free: np.ndarray, order: tuple[int, int, int]) -> np.ndarray:
    """AR and MA coefficients of free numbers (one row per series; at most two AR and one MA)."""
    p, _, q = order
    r = np.tanh(free)
    if p == 2:
        r = np.column_stack([r[:, 0] * (1 - r[:, 1]), r[:, 1:]])
    return r[:, : p + q]


def free_numbers(params: np.ndarray, order: tuple[int, int, int]) -> np.ndarray:
    """What `coefficients` maps to `params`; coefficients that are not stationary or invertible are moved inside."""
    p, _, _ = order
    r = params.copy()
    if p == 2:
        last = np.clip(r[:, 1], -0.999, 0.999)
        r[:, 0], r[:, 1] = r[:, 0] / (1 - last), last
    return np.arctanh(np.clip(r, -0.999, 0.999))


def _system(params: np.ndarray, order: tuple[int, int, int]):
    """Transition matrices, shock loadings, the observed combination and the first variances, per series."""
    p, d, q = order
    n, r = len(params), max(p, q + 1)
    size = r + d
    move, noise, seen = np.zeros((n, size, size)), np.zeros((n, size)), np.zeros(size)
    move[:, d : d + p, d] = params[:, :p]
    move[:, d : size - 1, d + 1 :] += np.eye(r - 1)
    noise[:, d] = 1.0
    noise[:, d + 1 : d + 1 + q] = params[:, p:]
    seen[d] = 1.0
    shocks = noise[:, :, None] * noise[:, None, :]
    block = move[:, d:, d:]
    # The stationary variance solves P = T P T' + R R'; where there is none, a wide one is taken.
    pair = np.einsum("nij,nkl->nikjl", block, block).reshape(n, r * r, r * r)
    with np.errstate(all="ignore"):
        try:
            still = np.linalg.solve(np.eye(r * r) - pair, shocks[:, d:, d:].reshape(n, r * r, 1)).reshape(n, r, r)
        except np.linalg.LinAlgError:
            still = np.full((n, r, r), np.nan)
    radius = np.abs(np.linalg.eigvals(block)).max(axis=1)
    bad = (radius >= 1) | ~np.isfinite(still).all(axis=(1, 2))
    spread = np.zeros((n, size, size))
    spread[:, d:, d:] = np.where(bad[:, None, None], np.eye(r) * DIFFUSE, still)
    if d:  # the level carries the previous value; the difference is added to it
        move[:, 0, 0], move[:, 0, 1], seen[0] = 1.0, 1.0, 1.0
        spread[:, 0, 0] = DIFFUSE
    return move, shocks, seen, spread


def run(series: np.ndarray, params: np.ndarray, order: tuple[int, int, int], horizon: int | None = None):
    """Log-likelihood of every series under its coefficients, and with a horizon the forecasts made
    at every place of the value so many places on. Nothing after a place enters its forecast."""
    d = order[1]
    move, shocks, seen, spread = _system(params, order)
    n, steps = series.shape
    state = np.zeros((n, len(seen)))
    turned = np.swapaxes(move, 1, 2)
    ahead = None if horizon is None else np.einsum("i,nij->nj", seen, np.linalg.matrix_power(move, horizon))
    out = np.empty_like(series) if horizon is not None else None
    squares, logs, count, met = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    there = np.isfinite(series)
    value = np.where(there, series, 0.0)
    for t in range(steps):
        now = there[:, t]
        if now.any():
            cross = spread @ seen
            scale = np.where(now, cross @ seen, 1.0)
            scale = np.maximum(scale, 1e-300)
            error = np.where(now, value[:, t] - state @ seen, 0.0)
            gain = np.where(now[:, None], cross / scale[:, None], 0.0)
            state = state + gain * error[:, None]
            spread = spread - gain[:, :, None] * cross[:, None, :]
            used = now & (met >= d)  # the first value only places the level
            squares += np.where(used, error * error / scale, 0.0)
            logs += np.where(used, np.log(scale), 0.0)
            count += used
            met += now
        if out is not None:
            out[:, t] = (ahead * state).sum(axis=1)
        state = (move @ state[:, :, None])[:, :, 0]
        spread = move @ spread @ turned + shocks
    with np.errstate(all="ignore"):
        loglik = -0.5 * (count * (np.log(2 * np.pi * squares / count) + 1) + logs)
    return np.where(np.isfinite(loglik), loglik, -np.inf), out


def _gradient(f, u: np.ndarray, series: np.ndarray) -> np.ndarray:
    n, k = u.shape
    steps = np.vstack([np.eye(k), -np.eye(k)]) * WIDTH
    tried = (u[None] + steps[:, None]).reshape(-1, k)
    found = f(tried, np.tile(series, (2 * k, 1))).reshape(2, k, n)
    with np.errstate(invalid="ignore"):
        return ((found[0] - found[1]) / (2 * WIDTH)).T


def fit(series: np.ndarray, order: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, log-likelihood and whether a fit was found, for every series.

    The likelihood is at least that of the two-step estimate, moved inside the stationary
    and invertible region if it lies outside.
    """
    k = order[0] + order[2]
    counts = np.maximum(np.isfinite(series).sum(axis=1), 1)
    f = lambda u, s: -run(s, coefficients(u, order), order)[0] / np.maximum(np.isfinite(s).sum(axis=1), 1)
    starts = [two_step(s, order) for s in series]
    begun = np.array([s is not None for s in starts])
    u = free_numbers(np.array([np.zeros(k) if s is None else s for s in starts]).reshape(len(series), k), order)
    plain = np.zeros_like(u)
    here, other = f(u, series), f(plain, series)
    u, here = np.where((other < here)[:, None], plain, u), np.minimum(here, other)
    shape = np.tile(np.eye(k), (len(series), 1, 1))
    slope = _gradient(f, u, series)
    open_ = np.flatnonzero(np.isfinite(here) & begun)
    for _ in range(ROUNDS):
        if not len(open_):
            break
        step = -(shape[open_] @ slope[open_][:, :, None])[:, :, 0]
        uphill = (step * slope[open_]).sum(axis=1) >= 0
        step[uphill], shape[open_[uphill]] = -slope[open_[uphill]], np.eye(k)
        step *= np.minimum(1.0, STRIDE / np.maximum(np.abs(step).max(axis=1), 1e-300))[:, None]
        taken, best, left = u[open_].copy(), here[open_].copy(), np.arange(len(open_))
        size = 1.0
        for _ in range(HALVINGS):
            tried = np.clip(u[open_[left]] + size * step[left], -LIMIT, LIMIT)
            found = f(tried, series[open_[left]])
            wanted = here[open_[left]] + 1e-4 * (slope[open_[left]] * (tried - u[open_[left]])).sum(axis=1)
            good = found <= np.minimum(wanted, here[open_[left]])
            taken[left[good]], best[left[good]] = tried[good], found[good]
            left = left[~good]
            if not len(left):
                break
            size /= 2
        gained = here[open_] - best
        moved, before = taken - u[open_], slope[open_]
        u[open_], here[open_] = taken, best
        going = gained > LEAST
        moved, before, open_ = moved[going], before[going], open_[going]
        if not len(open_):
            break
        slope[open_] = _gradient(f, u[open_], series[open_])
        turn = slope[open_] - before
        curve = (turn * moved).sum(axis=1)
        fine = curve > 1e-12
        s, y, c = moved[fine], turn[fine], curve[fine][:, None, None]
        side = np.eye(k) - s[:, :, None] * y[:, None, :] / c
        rows = open_[fine]
        shape[rows] = side @ shape[rows] @ np.swapaxes(side, 1, 2) + s[:, :, None] * s[:, None, :] / c
    return coefficients(u, order), -here * counts, np.isfinite(here) & begun
