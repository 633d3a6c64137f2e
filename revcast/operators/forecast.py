"""Additive trend + seasonality forecaster fitted for many series at once
(M1-M5, M7, M18, A11, P7).

Model (decomposable model in the spirit of Taylor & Letham, 2018)::

    y(d) = a + b·t + Σ_j δ_j·max(0, t - s_j)          trend, hinges at s_j
         + Σ_k (c_k sin + e_k cos)(2πk·d / 7)          weekly
         + Σ_k (f_k sin + g_k cos)(2πk·d / 365.25)     yearly

``t`` is years since the first day of the series and the changepoints
``s_j`` lie on an absolute grid (every ``changepoint_every`` days), so the
design row of a day does not depend on the forecast origin. The normal
equations of the fit on "all days up to cutoff c" are therefore cumulative
sums of per-segment Gram matrices (segments = days between consecutive
cutoffs): O(days x p²) per series however many cutoffs, never a
(day x cutoff) expansion. Only hinges inside the first ``changepoint_range``
of the training span are used for a given cutoff.

Spark does the heavy work (line-level aggregation to daily series, the
shuffle of each series to one group, the joins to truth and requests).
The per-series step (Gram sums + a p x p ridge solve per cutoff) is a small
numpy helper in ``applyInPandas``; a group is one series' calendar (one
row per day), bounded by the number of days, not by the data volume.
Horizon forecasts are produced from the coefficient rows by a vectorised
``mapInPandas``; :func:`predict` evaluates any frame of days as JVM
expressions.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import day_number

TWO_PI = 2.0 * math.pi
YEAR = 365.25


@dataclass(frozen=True)
class ForecastSpec:
    changepoint_every: int = 120          # days between candidate changepoints
    changepoint_range: float = 0.8        # hinges only in the first 80 % of history
    weekly_order: int = 3
    yearly_order: int = 4
    changepoint_prior_scale: float = 0.05
    seasonality_prior_scale: float = 10.0
    noise_scale: float = 0.2              # expected noise sd of y / max|y|
    interval_width: float = 0.8
    min_rows: int = 14

    def n_hinges(self, max_span_days: int) -> int:
        return max(1, int(max_span_days // self.changepoint_every))

    def hinge_penalty(self) -> float:
        return (self.noise_scale / self.changepoint_prior_scale) ** 2

    def season_penalty(self) -> float:
        return (self.noise_scale / self.seasonality_prior_scale) ** 2

    def z(self) -> float:
        # two-sided normal quantile of the interval width (inverse erf by Newton)
        p = 0.5 + self.interval_width / 2.0
        x = 0.0
        for _ in range(60):
            cdf = 0.5 * (1.0 + math.erf(x / math.sqrt(2.0)))
            x -= (cdf - p) / (math.exp(-x * x / 2.0) / math.sqrt(2.0 * math.pi))
        return x


@dataclass(frozen=True)
class Layout:
    """Column layout of the design vector for a given number of hinges."""
    spec: ForecastSpec
    hinges: int

    @property
    def n_trend(self) -> int:
        return 2 + self.hinges

    @property
    def n_weekly(self) -> int:
        return 2 * self.spec.weekly_order

    @property
    def p(self) -> int:
        return self.n_trend + self.n_weekly + 2 * self.spec.yearly_order

    def hinge_at(self, j: int) -> float:
        """Position (years since series start) of hinge j (0-based)."""
        return (j + 1) * self.spec.changepoint_every / YEAR

    def penalties(self, changepoint_prior_scale: float | None = None) -> np.ndarray:
        lam = np.full(self.p, self.spec.season_penalty())
        lam[0:2] = 1e-9
        cps = changepoint_prior_scale or self.spec.changepoint_prior_scale
        lam[2:self.n_trend] = (self.spec.noise_scale / cps) ** 2
        return lam


def design(layout: Layout, dn: Column, origin_dn: Column) -> list[Column]:
    """Design row (list of double columns) for day number ``dn``."""
    t = (dn - origin_dn).cast("double") / F.lit(YEAR)
    cols = [F.lit(1.0), t]
    for j in range(layout.hinges):
        cols.append(F.greatest(F.lit(0.0), t - F.lit(layout.hinge_at(j))))
    d = dn.cast("double")
    for k in range(1, layout.spec.weekly_order + 1):
        cols += [F.sin(d * F.lit(TWO_PI * k / 7.0)), F.cos(d * F.lit(TWO_PI * k / 7.0))]
    for k in range(1, layout.spec.yearly_order + 1):
        cols += [F.sin(d * F.lit(TWO_PI * k / YEAR)), F.cos(d * F.lit(TWO_PI * k / YEAR))]
    return cols


def layout_for(train: DataFrame, spec: ForecastSpec, horizon: int = 0) -> Layout:
    """Hinge count from the longest series span (one small aggregate)."""
    span = (train.groupBy("series_id")
            .agg((F.datediff(F.max("date"), F.min("date")) + F.lit(horizon)).alias("s"))
            .agg(F.max("s")).first()[0]) or 0
    return Layout(spec, spec.n_hinges(int(span)))


COEF_SCHEMA = T.StructType([
    T.StructField("series_id", T.StringType()),
    T.StructField("cutoff", T.DateType()),
    T.StructField("origin", T.DateType()),
    T.StructField("n", T.LongType()),
    T.StructField("beta", T.ArrayType(T.DoubleType())),
    T.StructField("sigma", T.DoubleType()),
    T.StructField("hinges_used", T.IntegerType()),
    T.StructField("cps", T.DoubleType()),
    T.StructField("fit_seconds", T.DoubleType()),
])

_EPOCH = np.datetime64("1970-01-01", "D")


def design_matrix(layout: Layout, dn: np.ndarray, origin_dn: float) -> np.ndarray:
    """numpy twin of :func:`design` (same columns, same order)."""
    t = (dn - origin_dn) / YEAR
    cols = [np.ones_like(t), t]
    cols += [np.maximum(0.0, t - layout.hinge_at(j)) for j in range(layout.hinges)]
    d = dn.astype(float)
    for k in range(1, layout.spec.weekly_order + 1):
        cols += [np.sin(d * (TWO_PI * k / 7.0)), np.cos(d * (TWO_PI * k / 7.0))]
    for k in range(1, layout.spec.yearly_order + 1):
        cols += [np.sin(d * (TWO_PI * k / YEAR)), np.cos(d * (TWO_PI * k / YEAR))]
    return np.column_stack(cols)


def causal_mask(y: np.ndarray, lo: float = 0.25, hi: float = 0.75) -> np.ndarray:
    """Null every value outside [q_lo, q_hi] of the values *before* it.

    Exact quantiles with linear interpolation at position (n-1)·p (the rule
    of Spark's ``percentile``), kept in a running sorted array: O(n log n)
    per series. The first value (nothing before it) is kept.
    """
    out = y.copy()
    seen: list[float] = []
    import bisect
    for t, v in enumerate(y):
        if np.isnan(v):
            continue
        if seen:
            n = len(seen)

            def q(p):
                pos = (n - 1) * p
                a, b = int(np.floor(pos)), int(np.ceil(pos))
                if a == b or seen[a] == seen[b]:
                    return seen[a]
                return (b - pos) * seen[a] + (pos - a) * seen[b]

            if not (q(lo) <= v <= q(hi)):
                out[t] = np.nan
        bisect.insort(seen, float(v))
    return out


def _cumulative_sums(X: np.ndarray, y: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """X'X, X'y and y'y of the rows up to each cutoff; segment s holds rows starts[s]..ends[s]."""
    p = X.shape[1]
    G, b, yy = np.zeros((len(ends), p, p)), np.zeros((len(ends), p)), np.zeros(len(ends))
    for s, (a, e) in enumerate(zip(starts, ends)):
        if e > a:
            G[s], b[s], yy[s] = X[a:e].T @ X[a:e], X[a:e].T @ y[a:e], y[a:e] @ y[a:e]
    return np.cumsum(G, 0), np.cumsum(b, 0), np.cumsum(yy)


def _series_fitter(layout: Layout, prior_scales=None, mask: str = "none"):
    """Per-series fit of every cutoff: segment Gram sums, cumulative sums,
    ridge solves. Input: one series' days (``_cut = 0``) and its cutoff
    markers (``_cut = 1``); at most (days + cutoffs) rows. With several
    ``prior_scales`` (M2 grid, J8) the same Gram sums are solved once per
    scale: the grid costs p x p solves, not extra passes over the data."""
    p = layout.p
    scales = list(prior_scales or [layout.spec.changepoint_prior_scale])
    spec = layout.spec
    hinge_pos = np.array([layout.hinge_at(j) for j in range(layout.hinges)])
    idx = np.arange(p)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        t_start = time.perf_counter()
        sid = pdf["series_id"].iloc[0]
        dn = (pd.to_datetime(pdf["date"]).to_numpy().astype("datetime64[D]") - _EPOCH).astype(np.int64)
        is_cut = pdf["_cut"].to_numpy() == 1
        y = pdf["_y"].to_numpy(dtype=float)
        days = ~is_cut
        cuts = np.sort(np.unique(dn[is_cut]))
        if not len(cuts) or not days.any():
            return pd.DataFrame(columns=[f.name for f in COEF_SCHEMA.fields])
        origin = float(dn[days].min())
        y_all = y
        if mask == "causal":
            # judge each day against the days before it (no look-ahead)
            order_all = np.argsort(np.where(days, dn, np.iinfo(np.int64).max), kind="stable")
            yd = y.copy()
            idx_days = order_all[:days.sum()]
            yd[idx_days] = causal_mask(y[idx_days])
            y = yd
        obs = days & ~np.isnan(y)
        d_obs, y_obs = dn[obs], y[obs]
        order = np.argsort(d_obs, kind="stable")
        d_obs, y_obs = d_obs[order], y_obs[order]
        X = design_matrix(layout, d_obs.astype(float), origin)
        # rows of segment s: cutoffs[s-1] < d <= cutoffs[s]
        ends = np.searchsorted(d_obs, cuts, side="right")
        starts = np.concatenate([[0], ends[:-1]])
        G, b, yy = _cumulative_sums(X, y_obs, starts, ends)
        n = ends.astype(np.int64)
        G_r, b_r, yy_r, n_r = G, b, yy, n
        if mask == "causal":
            seen = days & ~np.isnan(y_all)
            in_order = np.argsort(dn[seen], kind="stable")
            d_all = dn[seen][in_order]
            upto = np.searchsorted(d_all, cuts, side="right")
            G_r, b_r, yy_r = _cumulative_sums(design_matrix(layout, d_all.astype(float), origin), y_all[seen][in_order],
                                              np.concatenate([[0], upto[:-1]]), upto)
            n_r = upto.astype(np.int64)
        span = (cuts - origin) / YEAR
        used = np.zeros((len(cuts), layout.hinges), dtype=bool)
        if layout.hinges:
            used = hinge_pos[None, :] <= spec.changepoint_range * span[:, None]
        ok = n >= spec.min_rows
        frames = []
        for cps in scales:
            lam = layout.penalties(cps)
            A = G.copy()
            A[:, idx, idx] += lam[None, :]
            bb = b.copy()
            for j in range(layout.hinges):
                r = ~used[:, j]
                c = 2 + j
                A[r, c, :] = 0.0
                A[r, :, c] = 0.0
                A[r, c, c] = 1.0
                bb[r, c] = 0.0
            beta = np.full((len(cuts), p), np.nan)
            if ok.any():
                try:
                    beta[ok] = np.linalg.solve(A[ok], bb[ok][..., None])[..., 0]
                except np.linalg.LinAlgError:
                    for r in np.where(ok)[0]:
                        beta[r] = np.linalg.lstsq(A[r], bb[r], rcond=None)[0]
            # spread of all observed days up to the cutoff, masked ones too: what
            # the interval has to cover is the unmasked series
            rss = yy_r - 2 * np.einsum("ij,ij->i", beta, b_r) + np.einsum("ij,ijk,ik->i", beta, G_r, beta)
            sigma = np.sqrt(np.clip(rss, 0, None) / np.maximum(n_r - p, 1))
            frames.append(pd.DataFrame({
                "series_id": sid,
                "cutoff": (cuts + _EPOCH).astype("datetime64[D]").astype(object),
                "origin": np.full(len(cuts), (np.int64(origin) + _EPOCH)).astype("datetime64[D]").astype(object),
                "n": n,
                "beta": [list(v) if o else None for o, v in zip(ok, beta)],
                "sigma": np.where(ok, sigma, np.nan),
                "hinges_used": used.sum(axis=1).astype("int32"),
                "cps": float(cps),
            }))
        out = pd.concat(frames, ignore_index=True)
        # wall time of this series' fits, shared out over its cutoffs (train log)
        out["fit_seconds"] = (time.perf_counter() - t_start) / max(len(out), 1)
        return out

    return fit


def fit_forecaster(train: DataFrame, cutoffs: DataFrame, spec: ForecastSpec = ForecastSpec(),
                   value: str = "y", layout: Layout | None = None, horizon: int = 30,
                   prior_scales=None, mask: str = "none"):
    """M1: one fit per (series, cutoff) on the rows ``date <= cutoff``.

    ``train``: ``series_id, date, <value>`` (null = gap or masked, not used);
    ``cutoffs``: ``series_id, cutoff``. Day rows and cutoff markers of a
    series meet in one group (shuffle by ``series_id``); the group holds one
    row per calendar day of that series plus its cutoffs, so its size is
    set by the calendar, never by the invoice volume.

    ``mask="causal"`` nulls, inside the per-series step, every day outside
    the 25-75 % quantiles of the days before it (:func:`causal_mask`).

    Returns ``(coefficients, layout)``; one coefficient row per (series,
    cutoff): ``origin, n, beta[p], sigma, hinges_used``.
    """
    layout = layout or layout_for(train, spec, horizon)
    data = train.select("series_id", "date", F.col(value).cast("double").alias("_y"),
                        F.lit(0).alias("_cut"))
    marks = cutoffs.select("series_id", F.col("cutoff").alias("date"),
                           F.lit(None).cast("double").alias("_y"), F.lit(1).alias("_cut"))
    coefs = (data.unionByName(marks).groupBy("series_id")
             .applyInPandas(_series_fitter(layout, prior_scales, mask), COEF_SCHEMA))
    return coefs, layout


def _dot(beta: Column, xs: list[Column], lo: int, hi: int) -> Column:
    """Σ beta[i]·x_i for i in [lo, hi): a plain expression tree, so it stays
    inside whole-stage codegen (no lambda functions)."""
    out = None
    for i in range(lo, hi):
        term = beta.getItem(i) * xs[i]
        out = term if out is None else out + term
    return out if out is not None else F.lit(0.0)


def predict(coefs: DataFrame, frame: DataFrame, layout: Layout,
            keys=("series_id", "cutoff")) -> DataFrame:
    """M4 + M5: forecast rows for ``frame`` (keys + ``ds``) with components.

    ``trend``, ``weekly``, ``yearly``, ``yhat`` and the interval
    ``yhat_lower/upper`` (normal, ``interval_width``).
    """
    j = frame.join(coefs, on=list(keys), how="inner")
    return _components(j, layout)


def _components(j: DataFrame, layout: Layout) -> DataFrame:
    """trend / weekly / yearly / yhat / interval from ``beta`` and the design
    row of ``ds`` as JVM expressions (any frame of days to predict)."""
    x = design(layout, day_number("ds"), day_number("origin"))
    nt, nw, p = layout.n_trend, layout.n_weekly, layout.p
    trend = _dot(F.col("beta"), x, 0, nt)
    weekly = _dot(F.col("beta"), x, nt, nt + nw)
    yearly = _dot(F.col("beta"), x, nt + nw, p)
    z = layout.spec.z()
    out = j.select("*", trend.alias("trend"), weekly.alias("weekly"), yearly.alias("yearly"))
    yhat = F.col("trend") + F.col("weekly") + F.col("yearly")
    return (out.withColumn("yhat", yhat)
            .withColumn("yhat_lower", F.col("yhat") - F.lit(z) * F.col("sigma"))
            .withColumn("yhat_upper", F.col("yhat") + F.lit(z) * F.col("sigma"))
            .drop("beta", "origin", "n", "hinges_used", "sigma", "fit_seconds"))


FORECAST_SCHEMA = T.StructType([
    T.StructField("series_id", T.StringType()), T.StructField("cutoff", T.DateType()),
    T.StructField("cps", T.DoubleType()), T.StructField("ds", T.DateType()),
    T.StructField("trend", T.DoubleType()), T.StructField("weekly", T.DoubleType()),
    T.StructField("yearly", T.DoubleType()), T.StructField("yhat", T.DoubleType()),
    T.StructField("yhat_lower", T.DoubleType()), T.StructField("yhat_upper", T.DoubleType()),
])


def forecast_horizon(coefs: DataFrame, layout: Layout, horizon: int = 30) -> DataFrame:
    """M3 + M4 + M5: the ``horizon`` days after each cutoff.

    Built from the coefficient rows themselves (no join): each batch of
    coefficient rows becomes one numpy design matrix of ``rows x horizon``
    days and three matrix-vector products. The coefficient table is small
    (series x cutoffs), the output is ``horizon`` rows per coefficient row.
    """
    nt, nw, p = layout.n_trend, layout.n_weekly, layout.p
    z = layout.spec.z()
    hs = np.arange(1, horizon + 1)

    def expand(batches):
        for pdf in batches:
            m = len(pdf)
            if m == 0:
                continue
            ok = pdf["beta"].notna().to_numpy()
            cut = (pd.to_datetime(pdf["cutoff"]).to_numpy().astype("datetime64[D]") - _EPOCH).astype(np.int64)
            org = (pd.to_datetime(pdf["origin"]).to_numpy().astype("datetime64[D]") - _EPOCH).astype(np.int64)
            dn = (cut[:, None] + hs[None, :]).reshape(-1)
            X = design_matrix(layout, dn.astype(float), 0.0)
            # the trend columns depend on the origin: rebuild them per row
            t = (dn - np.repeat(org, horizon)) / YEAR
            X[:, 1] = t
            for j in range(layout.hinges):
                X[:, 2 + j] = np.maximum(0.0, t - layout.hinge_at(j))
            betas = [np.asarray(b, dtype=float) if o else np.zeros(p)
                     for o, b in zip(ok, pdf["beta"].to_numpy())]
            B = np.repeat(np.stack(betas), horizon, axis=0)
            prod = X * B
            trend = prod[:, :nt].sum(1)
            weekly = prod[:, nt:nt + nw].sum(1)
            yearly = prod[:, nt + nw:p].sum(1)
            yhat = trend + weekly + yearly
            sig = np.repeat(pdf["sigma"].to_numpy(dtype=float), horizon)
            valid = np.repeat(ok, horizon)

            def col(v):  # failed fits (no coefficients) give null forecasts
                if valid.all():
                    return v
                out = pd.array(v, dtype="Float64")
                out[~valid] = pd.NA
                return out

            yield pd.DataFrame({
                "series_id": np.repeat(pdf["series_id"].to_numpy(), horizon),
                "cutoff": np.repeat(pdf["cutoff"].to_numpy(), horizon),
                "cps": np.repeat(pdf["cps"].to_numpy(dtype=float), horizon),
                "ds": (dn + _EPOCH).astype("datetime64[D]").astype(object),
                "trend": col(trend), "weekly": col(weekly), "yearly": col(yearly),
                "yhat": col(yhat), "yhat_lower": col(yhat - z * sig), "yhat_upper": col(yhat + z * sig),
            })

    return coefs.mapInPandas(expand, FORECAST_SCHEMA)


def future_frame(train: DataFrame, cutoffs: DataFrame, periods: int = 30,
                 include_history: bool = True) -> DataFrame:
    """M3 (``make_future_dataframe``): history days plus ``periods`` days after
    each cutoff, keyed (series_id, cutoff, ds)."""
    fut = cutoffs.select("series_id", "cutoff",
                         F.explode(F.sequence(F.date_add("cutoff", 1),
                                              F.date_add("cutoff", periods))).alias("ds"))
    if not include_history:
        return fut
    hist = (train.select("series_id", F.col("date").alias("ds"))
            .join(cutoffs, on="series_id").where(F.col("ds") <= F.col("cutoff"))
            .select("series_id", "cutoff", "ds"))
    return hist.unionByName(fut)


def thirty_day_total(forecast: DataFrame, horizon: int = 30) -> DataFrame:
    """Σ yhat over the ``horizon`` days after each cutoff, with the interval
    of the sum: its variance is the sum of the days' variances, so half its
    width is the root of the sum of their squared half widths."""
    f = forecast.where((F.col("ds") > F.col("cutoff"))
                       & (F.col("ds") <= F.date_add("cutoff", horizon)))
    return f.groupBy("series_id", "cutoff").agg(
        F.sum("yhat").alias("yhat_total"),
        F.sqrt(F.sum(F.pow(F.col("yhat_upper") - F.col("yhat"), F.lit(2.0)))).alias("_half")).select(
        "series_id", "cutoff", "yhat_total", (F.col("yhat_total") - F.col("_half")).alias("yhat_lower_total"),
        (F.col("yhat_total") + F.col("_half")).alias("yhat_upper_total"))


# ---------------------------------------------------------------- baselines

def baseline_forecasts(train: DataFrame, cutoffs: DataFrame, horizon: int = 30,
                       season: int = 7, value: str = "y") -> DataFrame:
    """Naive, seasonal-naive and drift forecasts for each (series, cutoff).

    * naive: last observed value on or before the cutoff;
    * seasonal naive: value of the same phase in the last ``season`` days
      before the cutoff (``y(c + h - season·ceil(h/season))``);
    * drift: last value plus the average daily change from the first to the
      last observed value: ``y_T + (y_T - y_1)/(d_T - d_1) · (ds - d_T)``.

    The last observed value at each cutoff comes from a running
    ``last(ignorenulls)`` read at cutoff marker rows (one sort per series,
    no day x cutoff expansion); seasonal values are an equi-join lookup.
    """
    y = F.col(value).cast("double")
    data = train.select("series_id", "date", y.alias("_y"), F.lit(0).alias("_cut"))
    marks = cutoffs.select("series_id", F.col("cutoff").alias("date"),
                           F.lit(None).cast("double").alias("_y"), F.lit(1).alias("_cut"))
    part = Window.partitionBy("series_id")
    run = part.orderBy("date", "_cut").rowsBetween(Window.unboundedPreceding, 0)
    first_d = F.min(F.when(F.col("_y").isNotNull(), F.col("date"))).over(part)
    first_y = F.min_by(F.col("_y"), F.when(F.col("_y").isNotNull(), F.col("date"))).over(part)
    ends = (data.unionByName(marks)
            .select("series_id", "date", "_cut",
                    first_y.alias("y_first"), first_d.alias("d_first"),
                    F.last("_y", ignorenulls=True).over(run).alias("y_last"),
                    F.last(F.when(F.col("_y").isNotNull(), F.col("date")), ignorenulls=True)
                    .over(run).alias("d_last"))
            .where(F.col("_cut") == 1)
            .select("series_id", F.col("date").alias("cutoff"), "y_first", "d_first",
                    "y_last", "d_last"))
    fut = ends.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    fut = fut.withColumn("ds", F.date_add("cutoff", F.col("h")))
    back = F.lit(season) * F.ceil(F.col("h") / F.lit(season)).cast("int")
    fut = fut.withColumn("_sd", F.date_add("cutoff", F.col("h") - back))
    seas = train.select("series_id", F.col("date").alias("_sd"), y.alias("yhat_snaive"))
    slope = (F.col("y_last") - F.col("y_first")) / F.nullif(
        F.datediff("d_last", "d_first").cast("double"), F.lit(0.0))
    return (fut.join(seas, on=["series_id", "_sd"], how="left")
            .select("series_id", "cutoff", "ds", F.col("h").cast("bigint").alias("h"),
                    F.col("y_last").alias("yhat_naive"),
                    "yhat_snaive",
                    (F.col("y_last") + F.coalesce(slope, F.lit(0.0))
                     * F.datediff("ds", "d_last").cast("double")).alias("yhat_drift")))


def drift_forecast_table(series: DataFrame, horizon: int = 30, value: str = "y") -> DataFrame:
    """M21 (baseline flavour): a materialised forecast for every (series, day).

    For origin day ``d`` (cutoff ``c = d - 1``) the drift forecast of the next
    ``horizon`` days summed in closed form::

        H·y_T + slope · (H·(c - d_T) + H(H+1)/2),  slope = (y_T - y_1)/(d_T - d_1)

    where ``y_T``/``d_T`` is the last observation before ``d`` and
    ``y_1``/``d_1`` the first of the series. Windows only (one sort per
    series); rows before the first observation get null.
    """
    y = F.col(value).cast("double")
    part = Window.partitionBy("series_id")
    before = part.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    obs_date = F.when(y.isNotNull(), F.col("date"))
    t = series.select(
        "series_id", "date",
        F.min_by(y, obs_date).over(part).alias("y_first"),
        F.min(obs_date).over(part).alias("d_first"),
        F.last(y, ignorenulls=True).over(before).alias("y_last"),
        F.last(obs_date, ignorenulls=True).over(before).alias("d_last"))
    c = F.date_sub("date", 1)
    slope = (F.col("y_last") - F.col("y_first")) / F.nullif(
        F.datediff("d_last", "d_first").cast("double"), F.lit(0.0))
    steps = (F.lit(horizon) * F.datediff(c, "d_last") + F.lit(horizon * (horizon + 1) // 2)).cast("double")
    total = F.lit(float(horizon)) * F.col("y_last") + F.coalesce(slope, F.lit(0.0)) * steps
    return t.select("series_id", "date", total.alias("yhat_30d"))
