"""Candidate fits by least squares on one series' own days: what the sums of
``revcast.operators.arima`` must equal."""

import numpy as np

from revcast.operators.arima import first_common_row


def _lagmat(x: np.ndarray, lags: list[int]) -> np.ndarray:
    n = len(x)
    out = np.full((n, len(lags)), np.nan)
    for j, L in enumerate(lags):
        if L < n:
            out[L:, j] = x[:n - L]
    return out


def _difference(y: np.ndarray, d: int, D: int, s: int) -> np.ndarray:
    w = y.copy()
    for _ in range(d):
        w = w[1:] - w[:-1]
    for _ in range(D):
        w = w[s:] - w[:-s]
    return w


def hannan_rissanen(y: np.ndarray, order) -> tuple[float | None, dict, int]:
    """Fit one candidate; returns ``(aic, coefficients, n_used)``.

    Every candidate is scored on the same days (:func:`first_common_row`). Its
    residuals are one-step errors of ``y`` itself, whatever the differencing,
    so the scores compare and their order does not depend on the unit of ``y``.
    """
    p, d, q, P, D, Q, s = order
    start, m = first_common_row(len(y), s)
    w = _difference(np.asarray(y, float), d, D, s)
    const = d + D == 0
    ar_lags = [i for i in range(1, p + 1)] + [s * i for i in range(1, P + 1)]
    ma_lags = [i for i in range(1, q + 1)] + [s * i for i in range(1, Q + 1)]
    n = len(w)
    k = len(ar_lags) + len(ma_lags) + int(const)
    if n < 4 * max([1] + ar_lags + ma_lags) or n < 30:
        return None, {}, n
    e = np.full(n, np.nan)
    if ma_lags:
        Z = _lagmat(w, list(range(1, m + 1)))
        ok = ~np.isnan(Z).any(axis=1)
        Zc = np.column_stack([np.ones(ok.sum()), Z[ok]])
        coef, *_ = np.linalg.lstsq(Zc, w[ok], rcond=None)
        e[ok] = w[ok] - Zc @ coef
    cols, names = [], []
    if const:
        cols.append(np.ones(n))
        names.append("const")
    for L in ar_lags:
        cols.append(_lagmat(w, [L])[:, 0])
        names.append(f"ar.L{L}")
    for L in ma_lags:
        cols.append(_lagmat(e, [L])[:, 0])
        names.append(f"ma.L{L}")
    common = np.arange(n) + d + D * s >= start
    if not cols:
        resid = w[common]
        used = len(resid)
        if used < 2:
            return None, {}, used
    else:
        X = np.column_stack(cols)
        ok = common & ~np.isnan(X).any(axis=1)
        if ok.sum() <= k + 1:
            return None, {}, int(ok.sum())
        beta, *_ = np.linalg.lstsq(X[ok], w[ok], rcond=None)
        resid = w[ok] - X[ok] @ beta
        used = int(ok.sum())
        coefs = dict(zip(names, beta.tolist()))
    rss = float(resid @ resid)
    if rss <= 0 or not np.isfinite(rss):
        return None, {}, used
    aic = used * np.log(rss / used) + 2 * (k + 1)
    out = coefs if cols else {}
    out["sigma2"] = rss / used
    return float(aic), out, used
