"""Seasonal ARIMA candidate grid, recursive and direct multi-step forecasts
(M15, M16, A12, M19, M20).

All three are regressions on lags, so their normal equations are sums of
lagged products. Spark adds these up in the JVM with lag windows; what Python
gets is one row of sums for each series (M15), each (series, cutoff) (M19) or
each (series, cutoff, step) (M20), solved a batch of rows at a time.

* M15/M16: every candidate order ``(p,d,q)(P,D,Q,s)`` is fitted by two-stage
  conditional least squares (Hannan & Rissanen, 1982): a long AR fit gives
  innovation estimates, then one regression on AR lags and lagged
  innovations. AIC = n·ln(RSS/n) + 2k. Differences and innovations are linear
  in the lags of the series, so all 64 candidates come from the same sums.
* M19: recursive forecast from an AR model on lags 1..L, each prediction
  fed back as the next input, for all cutoffs side by side.
* M20: direct ("ensemble") forecast: one linear model per horizon step h,
  targets shifted by h with a date-shifted self-join.

Days without a value (null, NaN) are left out before the lags of M15 and M19
are taken. Sums run in date order, so they do not depend on the partitions.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Each of p, d, q, P, D, Q ranges over {0, 1}
ORDER_VALUES = (0, 1)


def candidate_orders(season: int = 7):
    """The 64 candidate orders ``(p,d,q,P,D,Q,s)``."""
    return [(p, d, q, P, D, Q, season) for p, d, q in itertools.product(ORDER_VALUES, repeat=3)
            for P, D, Q in itertools.product(ORDER_VALUES, repeat=3)]


def first_common_row(n: int, s: int) -> tuple[int, int]:
    """(first day on which every candidate of season ``s`` has all its lags, order of the long AR fit)."""
    m = min(max(2 * s, 10), n // 4)
    return 1 + s + m + s, m


#: Relative to its largest one, an eigenvalue of normal equations that counts as zero.
RANK_TOLERANCE = 1e-12


def _solve(gram: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Least-squares coefficients of every (gram, rhs) of a batch; the shortest where columns depend on each other."""
    return (np.linalg.pinv(gram, rcond=RANK_TOLERANCE, hermitian=True) @ rhs[..., None])[..., 0]


def _scaled(series: DataFrame, value: str) -> DataFrame:
    """(series_id, date, shift, spread, n, z): days with a value, centred and scaled by series.

    The regressions have an intercept, so shift and spread cancel out of the
    results; they only keep the sums of products well conditioned.
    """
    whole = Window.partitionBy("series_id").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    days = series.select("series_id", "date", F.col(value).cast("double").alias("_y")).where("_y IS NOT NULL AND NOT isnan(_y)")
    days = days.select("*", F.avg("_y").over(whole).alias("shift"), F.stddev_pop("_y").over(whole).alias("_sd"), F.count("_y").over(whole).alias("n"))
    spread = F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)
    return days.select("series_id", "date", "shift", spread.alias("spread"), "n", ((F.col("_y") - F.col("shift")) / spread).alias("z"))


def lag_sums(series: DataFrame, max_lag: int, value: str = "y") -> DataFrame:
    """One row for each series: ``shift``, ``spread``, ``n``, the sum ``total`` of
    the scaled values, ``products[k]`` = Σ z(t)·z(t-k) for k = 0..max_lag, and the
    first and last ``max_lag`` values (``head``, ``tail``, in date order), from
    which the sums over any later first row follow."""
    by_date = Window.partitionBy("series_id").orderBy("date")
    days = _scaled(series, value).select(
        "*", F.row_number().over(by_date).alias("_pos"), *(F.lag("z", k).over(by_date).alias(f"_l{k}") for k in range(1, max_lag + 1)))

    def edge(rows: Column) -> Column:
        kept = F.sort_array(F.collect_list(F.when(rows, F.struct("_pos", "z"))))
        return F.transform(kept, lambda v: v["z"])

    products = [F.coalesce(F.sum(F.col("z") * F.col(f"_l{k}" if k else "z")), F.lit(0.0)) for k in range(max_lag + 1)]
    return days.groupBy("series_id").agg(
        F.first("shift").alias("shift"), F.first("spread").alias("spread"), F.first("n").alias("n"), F.sum("z").alias("total"),
        F.array(*products).alias("products"),
        edge(F.col("_pos") <= max_lag).alias("head"), edge(F.col("_pos") > F.col("n") - max_lag).alias("tail"))


def _gram(total, products, head, tail, n, first: int) -> np.ndarray:
    """Products of (1, z(t), z(t-1), ..., z(t-first)) summed over the rows t >= first, for a batch of series.

    A sum over shifted rows is the sum over all rows less a few at both ends.
    """
    out = np.empty((len(n), first + 2, first + 2))
    begin, end = head[:, :first], tail[:, tail.shape[1] - first:]
    zero = np.zeros((len(n), 1))
    out[:, 0, 0] = n - first
    before = np.hstack([zero, np.cumsum(begin, 1)])
    after = np.hstack([zero, np.cumsum(end[:, ::-1], 1)])
    for j in range(first + 1):
        out[:, 0, 1 + j] = out[:, 1 + j, 0] = total - before[:, first - j] - after[:, j]
    for k in range(first + 1):
        low = np.hstack([zero, np.cumsum(begin[:, k:] * begin[:, :first - k], 1)])
        high = np.hstack([zero, np.cumsum((end[:, k:] * end[:, :first - k])[:, ::-1], 1)])
        for i in range(first + 1 - k):
            out[:, 1 + i, 1 + i + k] = out[:, 1 + i + k, 1 + i] = products[:, k] - low[:, first - i - k] - high[:, i]
    return out


def _difference_weights(d: int, D: int, s: int) -> np.ndarray:
    """Weights of z(t), z(t-1), ... in the differenced series."""
    seasonal = np.zeros(s + 1)
    seasonal[0], seasonal[s] = 1.0, -1.0
    weights = np.ones(1)
    for factor in [np.array([1.0, -1.0])] * d + [seasonal] * D:
        weights = np.convolve(weights, factor)
    return weights


def _at_lag(weights: np.ndarray, lag: int, size: int) -> np.ndarray:
    """The differenced series ``lag`` rows earlier, over (1, z(t), ..., z(t-size+2))."""
    out = np.zeros(size)
    out[1 + lag:1 + lag + len(weights)] = weights
    return out


def _fit_candidates(rows: pd.DataFrame, orders: list[tuple], s: int, m: int) -> list[tuple]:
    """Every candidate of a batch of series whose long AR fit has ``m`` lags."""
    n = rows["n"].to_numpy()
    shift, spread = rows["shift"].to_numpy(float), rows["spread"].to_numpy(float)
    start, size = 1 + s + m + s, 1 + s + m + s + 2
    common = None
    if (n > start).all():
        head, tail = (np.stack([np.asarray(v, float)[part] for v in rows[c]]) for c, part in (("head", slice(start)), ("tail", slice(-start, None))))
        sums = [rows["total"].to_numpy(float), np.stack([np.asarray(v, float) for v in rows["products"]]), head, tail, n]
        common = _gram(*sums, start)
    innovations: dict[tuple, np.ndarray] = {}

    def innovation(d: int, D: int) -> np.ndarray:
        """Coefficients of the long AR fit: intercept, lags 1..m."""
        if (d, D) not in innovations:
            weights = _difference_weights(d, D, s)
            first = m + d + D * s
            gram = _gram(*sums, first)
            w = np.stack([_at_lag(weights, i, first + 2) for i in range(m + 1)], 1)
            x = np.column_stack([np.eye(first + 2)[:, 0], w[:, 1:]])
            innovations[d, D] = _solve(x.T @ gram @ x, x.T @ gram @ w[:, 0])
        return innovations[d, D]

    out = []
    for p, d, q, P, D, Q, _ in orders:
        spec = f"({p},{d},{q})x({P},{D},{Q},{s})"
        length = np.maximum(n - d - D * s, 0)
        const = d + D == 0
        ar = list(range(1, p + 1)) + [s * i for i in range(1, P + 1)]
        ma = list(range(1, q + 1)) + [s * i for i in range(1, Q + 1)]
        names = ["const"] * const + [f"ar.L{lag}" for lag in ar] + [f"ma.L{lag}" for lag in ma]
        k = len(names)
        long_enough = (length >= 30) & (length >= 4 * max([1] + ar + ma))
        used = n - start
        good = long_enough & (used > (k + 1 if k else 1))
        if common is not None and good.any():
            weights = _difference_weights(d, D, s)
            target = _at_lag(weights, 0, size)
            x = np.zeros((len(n), size, k))
            if const:
                x[:, 0, 0] = 1.0
            for at, lag in enumerate(ar, int(const)):
                x[:, :, at] = _at_lag(weights, lag, size)
            for at, lag in enumerate(ma, int(const) + len(ar)):
                coef = innovation(d, D)
                x[:, :, at] = _at_lag(weights, lag, size) - coef[:, 1:] @ np.stack([_at_lag(weights, lag + i, size) for i in range(1, m + 1)])
                x[:, 0, at] -= coef[:, 0]
            xt = x.transpose(0, 2, 1) @ common
            beta = _solve(xt @ x, xt @ target) if k else np.zeros((len(n), 0))
            error = target - np.einsum("bij,bj->bi", x, beta)
            rss = np.einsum("bi,bij,bj->b", error, common, error)
            good &= rss > RANK_TOLERANCE * np.maximum(np.einsum("i,bij,j->b", target, common, target), 1.0)
        for i, sid in enumerate(rows["series_id"]):
            if not good[i]:
                out.append((sid, spec, None, int(used[i] if long_enough[i] else length[i]), {}))
                continue
            terms = dict(zip(names, beta[i].tolist(), strict=True))
            if const:
                terms["const"] = terms["const"] * spread[i] + shift[i] * (1 - sum(terms[f"ar.L{lag}"] for lag in ar))
            terms["sigma2"] = float(rss[i] / used[i] * spread[i] ** 2)
            out.append((sid, spec, float(used[i] * np.log(terms["sigma2"]) + 2 * (k + 1)), int(used[i]), terms))
    return out


GRID_SCHEMA = T.StructType([
    T.StructField("series_id", T.StringType()), T.StructField("spec", T.StringType()),
    T.StructField("aic", T.DoubleType()), T.StructField("n", T.LongType()),
    T.StructField("terms", T.MapType(T.StringType(), T.DoubleType())),
])


def arima_grid(series: DataFrame, season: int = 7, value: str = "y") -> DataFrame:
    """AIC of every candidate order for every series (gap-free input,
    e.g. interpolated). One row per (series, candidate).

    Every candidate of a series is scored on the same days
    (:func:`first_common_row`). Its residuals are one-step errors of the series
    itself, whatever the differencing, so the scores compare and their order
    does not depend on the unit of the values. The AIC is null where the
    history is too short or the fit is exact to rounding (a constant series).
    """
    orders = candidate_orders(season)

    def fit(batches):
        for rows in batches:
            for m, part in rows.groupby(rows["n"].map(lambda n: first_common_row(n, season)[1])):
                # series too short for a common row stand apart from the batch that is solved
                for _, same in part.groupby(part["n"] > first_common_row(4 * m, season)[0]):
                    yield pd.DataFrame(_fit_candidates(same, orders, season, int(m)), columns=["series_id", "spec", "aic", "n", "terms"])

    return lag_sums(series, first_common_row(4 * max(2 * season, 10), season)[0], value).mapInPandas(fit, GRID_SCHEMA)


def best_candidate(grid: DataFrame) -> DataFrame:
    """Lowest-AIC candidate per series (ties by spec text); M16 terms."""
    w = Window.partitionBy("series_id").orderBy(F.col("aic").asc_nulls_last(), "spec")
    return (grid.where(F.col("aic").isNotNull())
            .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn"))


def coefficient_table(best: DataFrame) -> DataFrame:
    """The chosen model's coefficients as rows ``(series, spec, term, estimate)``."""
    return best.select("series_id", "spec", F.explode("terms").alias("term", "estimate"))


# ---------------------------------------------------------------- M19 recursive

def recursive_forecast(series: DataFrame, cutoffs: DataFrame, lags: int = 7,
                       horizon: int = 30, value: str = "y") -> DataFrame:
    """AR(lags) fitted on days ≤ cutoff, forecast fed back step by step.

    Input should be gap-free (e.g. interpolated). The sums of lagged products
    at every cutoff are running sums over the days with the cutoffs merged in;
    a batch of (series, cutoff) rows is solved at once and takes its steps
    together. Every cutoff gets a row for each step: ``status`` is ``ok``, or
    ``short history`` (under 3·lags + 10 days; ``yhat`` is null).
    """
    by_date = Window.partitionBy("series_id").orderBy("date")
    names = ["_one", *(f"_l{k}" for k in range(1, lags + 1)), "z"]
    pairs = [(i, j) for i in range(lags + 2) for j in range(i, lags + 2)]
    cols = [f"g{i}_{j}" for i, j in pairs]
    days = _scaled(series, value).select(
        "*", F.lit(1.0).alias("_one"), *(F.lag("z", k).over(by_date).alias(f"_l{k}") for k in range(1, lags + 1)))
    full = F.col(f"_l{lags}").isNotNull()
    days = days.select(
        "series_id", "date", "shift", "spread", F.lit(0).alias("_cut"), F.lit(1).alias("_day"),
        F.array("z", *(f"_l{k}" for k in range(1, lags))).alias("_last"),
        *(F.when(full, F.col(names[i]) * F.col(names[j])).alias(c) for c, (i, j) in zip(cols, pairs, strict=True)))
    marks = cutoffs.select("series_id", F.col("cutoff").alias("date"), F.lit(1).alias("_cut")).distinct()
    run = Window.partitionBy("series_id").orderBy("date", "_cut").rowsBetween(Window.unboundedPreceding, 0)
    at_cutoffs = (days.unionByName(marks, allowMissingColumns=True)
                  .select("series_id", F.col("date").alias("cutoff"), "_cut",
                          F.coalesce(F.sum("_day").over(run), F.lit(0)).alias("n"),
                          *(F.last(c, ignorenulls=True).over(run).alias(c) for c in ("shift", "spread", "_last")),
                          *(F.sum(c).over(run).alias(c) for c in cols))
                  .where("_cut = 1"))
    least = 3 * lags + 10

    def solve(batches):
        upper = np.triu_indices(lags + 2)
        for rows in batches:
            n = len(rows)
            ok = rows["n"].to_numpy() >= least
            yhat = np.full((n, horizon), np.nan)
            if ok.any():
                fit = rows[ok]
                gram = np.zeros((len(fit), lags + 2, lags + 2))
                gram[:, upper[0], upper[1]] = fit[cols].to_numpy(float)
                gram += np.triu(gram, 1).transpose(0, 2, 1)
                beta = _solve(gram[:, :-1, :-1], gram[:, :-1, -1])
                last = np.stack([np.asarray(v, float) for v in fit["_last"]])
                steps = np.empty((len(fit), horizon))
                for h in range(horizon):
                    steps[:, h] = beta[:, 0] + (beta[:, 1:] * last).sum(1)
                    last = np.column_stack([steps[:, h], last[:, :-1]])
                yhat[ok] = steps * fit["spread"].to_numpy(float)[:, None] + fit["shift"].to_numpy(float)[:, None]
            yield pd.DataFrame({"series_id": np.repeat(rows["series_id"].to_numpy(), horizon), "cutoff": np.repeat(rows["cutoff"].to_numpy(), horizon),
                                "h": np.tile(np.arange(1, horizon + 1, dtype="int32"), n), "yhat": yhat.ravel(),
                                "status": np.repeat(np.where(ok, "ok", "short history"), horizon)})

    out = at_cutoffs.mapInPandas(solve, "series_id string, cutoff date, h int, yhat double, status string")
    return out.select("series_id", "cutoff", F.date_add("cutoff", F.col("h")).alias("ds"), "h",
                      F.when(F.col("status") == "ok", F.col("yhat")).alias("yhat"), "status")


# ---------------------------------------------------------------- M20 direct

DIRECT_LAGS = (0, 1, 6, 13)


def sums_at_cutoffs(rows: DataFrame, days: DataFrame, cutoffs: DataFrame, order_col: str, key: str,
                    key_values: Column, sum_cols: list) -> DataFrame:
    """Σ of ``sum_cols`` over the rows with ``order_col <= cutoff``, for every
    (series, key, cutoff), without pairing rows with cutoffs.

    ``days`` holds the (series_id, date) that ``order_col`` takes and
    ``key_values`` the array of keys, so ``rows``, the large side, is read once.

    Each day gets its segment (the number of cutoffs strictly before it)
    from a running count over the merged day/cutoff markers; rows are
    aggregated per segment (partial sums before the shuffle); a running sum
    over the segment and cutoff rows of each (series, key) is read
    at the cutoffs. Cost is linear in rows + cutoffs.
    """
    days = days.select("series_id", "date").distinct().withColumn("_cut", F.lit(0))
    marks = cutoffs.select("series_id", F.col("cutoff").alias("date"), F.lit(1).alias("_cut"))
    run = (Window.partitionBy("series_id").orderBy("date", "_cut")
           .rowsBetween(Window.unboundedPreceding, 0))
    tagged = days.unionByName(marks).withColumn("_k", F.sum("_cut").over(run))
    seg_of = tagged.where(F.col("_cut") == 0).select("series_id", F.col("date").alias(order_col),
                                                     F.col("_k").alias("_seg"))
    mk = tagged.where(F.col("_cut") == 1).select("series_id", F.col("date").alias("cutoff"),
                                                 ((F.col("_k") - 1) * 2 + 1).alias("_ord"))
    seg = (rows.join(seg_of, on=["series_id", order_col])
           .groupBy("series_id", key, "_seg")
           .agg(*[F.sum(c).alias(c) for c in sum_cols])
           .select("series_id", key, (F.col("_seg") * 2).alias("_ord"),
                   F.lit(None).cast("date").alias("cutoff"), *sum_cols))
    mk = mk.select("*", F.explode(key_values).alias(key))  # cutoffs x keys (e.g. horizon steps)
    merged = seg.unionByName(mk, allowMissingColumns=True)
    cum = (Window.partitionBy("series_id", key).orderBy("_ord")
           .rowsBetween(Window.unboundedPreceding, 0))
    return (merged.select("series_id", key, "cutoff",
                          *[F.coalesce(F.sum(c).over(cum), F.lit(0.0)).alias(c) for c in sum_cols])
            .where(F.col("cutoff").isNotNull()))


def direct_forecast(series: DataFrame, cutoffs: DataFrame, horizon: int = 30,
                    value: str = "y", ridge: float = 1e-6) -> DataFrame:
    """One linear model per horizon step ``h`` on ``[1, y(d-l) for l in DIRECT_LAGS]``.

    Lags come from lag windows; the target ``y(d+h)`` from an equi-join on
    the date shifted by h (fan-out = horizon, bounded). The normal
    equations of every (series, cutoff, h) fit over rows with
    ``d + h <= cutoff`` come from :func:`sums_at_cutoffs` (15 sums, in the
    JVM); one vectorised pandas step solves them and applies each model to
    the lag vector at its cutoff.
    """
    y = F.col(value).cast("double")
    w = Window.partitionBy("series_id").orderBy("date")
    lagged = series.select("series_id", "date",
                           *[F.lag(y, L).over(w).alias(f"l{L}") if L else y.alias("l0")
                             for L in DIRECT_LAGS]).withColumn("one", F.lit(1.0))
    feats = ["one"] + [f"l{L}" for L in DIRECT_LAGS]
    p = len(feats)
    steps = F.sequence(F.lit(1), F.lit(horizon))
    tgt = series.select("series_id", F.col("date").alias("_td"), y.alias("target"))
    rows = (lagged.select("*", F.explode(steps).alias("h")).withColumn("_td", F.date_add("date", F.col("h")))
            .join(tgt, on=["series_id", "_td"]))
    ok = F.col("target").isNotNull()
    for f_ in feats:
        ok = ok & F.col(f_).isNotNull()
    gcols = [f"g{i}_{j}" for i in range(p) for j in range(i, p)]
    bcols = [f"b{i}" for i in range(p)]
    prods = ([(F.col(feats[i]) * F.col(feats[j])).alias(f"g{i}_{j}") for i in range(p) for j in range(i, p)]
             + [(F.col(feats[i]) * F.col("target")).alias(f"b{i}") for i in range(p)]
             + [F.lit(1.0).alias("n")])
    rows = rows.where(ok).select("series_id", "h", "_td", *prods)
    gram = sums_at_cutoffs(rows, series, cutoffs, "_td", "h", steps, gcols + bcols + ["n"])
    at_cut = lagged.select("series_id", F.col("date").alias("cutoff"),
                           *[F.col(f_).alias(f"x_{f_}") for f_ in feats])
    g = gram.join(at_cut, on=["series_id", "cutoff"])

    def solve(batches):
        iu = np.triu_indices(p)
        for pdf in batches:
            m = len(pdf)
            G = np.zeros((m, p, p))
            G[:, iu[0], iu[1]] = pdf[gcols].to_numpy(float)
            G = G + np.triu(G, 1).transpose(0, 2, 1) + ridge * np.eye(p)[None]
            b = pdf[bcols].to_numpy(float)
            x = pdf[[f"x_{f_}" for f_ in feats]].to_numpy(float)
            ok_ = (pdf["n"].to_numpy() > 2 * p) & ~np.isnan(x).any(axis=1)
            yhat = np.full(m, np.nan)
            if ok_.any():
                beta = np.linalg.solve(G[ok_], b[ok_][..., None])[..., 0]
                yhat[ok_] = np.einsum("ij,ij->i", beta, x[ok_])
            yield pd.DataFrame({"series_id": pdf["series_id"], "cutoff": pdf["cutoff"],
                                "h": pdf["h"].astype("int32"), "yhat": yhat})

    out = g.mapInPandas(solve, "series_id string, cutoff date, h int, yhat double")
    return out.withColumn("ds", F.date_add("cutoff", F.col("h")))
