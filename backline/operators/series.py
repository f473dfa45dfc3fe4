"""Time-series operators over ``(artist_id, platform, date)`` metrics.

The metric table holds one row per artist, platform and day, so a series is as long as the
calendar: a per-series window or sorted array has an upper bound that does not grow with the
number of artists or source rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from backline.functions import lookup
from backline.functions.refdata import GROWTH_WEIGHTS, PLATFORMS, SNAPSHOT_COLUMNS, STREAM_PLATFORMS
from backline.functions.rounding import cents_sum, clamp, half_even, half_up

SERIES = ["artist_id", "platform"]


def canon_platform(c: Column) -> Column:
    return F.translate(F.lower(F.trim(c)), "- ", "__")


def normalize_metrics(metrics: DataFrame) -> DataFrame:
    """Clean metric rows: platform spelling, bad numbers to 0, video views from streams or followers."""

    def num(c: str) -> Column:
        v = F.col(c).try_cast("double")
        return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(None)).otherwise(v)

    out = metrics.withColumn("platform", canon_platform(F.col("platform")))
    fol, stream = F.coalesce(num("followers"), F.lit(0.0)), F.coalesce(num("streams"), F.lit(0.0))
    backup = F.when(F.col("platform") == "youtube", F.when(stream != 0, stream).otherwise(fol)).otherwise(F.lit(0.0))
    return out.select(
        "artist_id", "platform", F.col("date"), fol.alias("followers"), stream.alias("streams"),
        F.coalesce(num("views"), backup).alias("views"),
        *[F.coalesce(num(c), F.lit(0.0)).alias(c) for c in ("likes", "comments", "shares")],
    )


def _leading() -> Column:
    x = (
        F.when(F.col("platform").isin(STREAM_PLATFORMS), F.col("streams"))
        .when(F.col("platform") == "youtube", F.col("views"))
        .otherwise(F.col("followers"))
    )
    return x.cast("double")


def primary_metric(metrics: DataFrame) -> DataFrame:
    """Leading measure per platform as ``x``."""
    return metrics.select("artist_id", "platform", "date", _leading().alias("x")).where("x is not null")


def _rate(end: Column, start: Column, n: Column) -> Column:
    ok = (n >= 2) & start.isNotNull() & (start > 0)
    return F.when(ok, half_even((end - start) / F.when(start > 0, start) * 100.0, 4)).otherwise(F.lit(0.0))


def growth_windows(series: DataFrame, windows=(7, 30, 90)) -> DataFrame:
    """Newest value against the last value at or before ``newest date - w``, in percent."""
    dated = series.withColumn("last_date", F.max("date").over(W.partitionBy(*SERIES)))
    past = [
        F.max_by(F.when(F.col("date") <= F.date_sub("last_date", w), F.col("x")),
                 F.when(F.col("date") <= F.date_sub("last_date", w), F.col("date"))).alias(f"past_{w}")
        for w in windows
    ]
    g = dated.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("points"), F.max_by("x", "date").alias("current_value"), *past)
    return g.select(*SERIES, "points", "current_value", *[_rate(F.col("current_value"), F.col(f"past_{w}"), F.col("points")).alias(f"rog_{w}d") for w in windows])


def recalc_daily_growth(metrics: DataFrame) -> DataFrame:
    """Change of followers against the previous row when it is 1 to 7 days old."""
    w = W.partitionBy(*SERIES).orderBy("date")
    prev, prev_day = F.lag("followers").over(w).cast("double"), F.lag("date").over(w)
    df = metrics.withColumn("prev", prev).withColumn("gap", F.datediff("date", prev_day))
    ok = F.col("gap").between(1, 7) & (F.col("prev") > 0)
    rate = (F.col("followers").cast("double") - F.col("prev")) / F.when(F.col("prev") > 0, F.col("prev")) * 100.0
    return df.withColumn("rog_daily", F.when(ok, half_up(rate, 4))).drop("prev", "gap")


def growth_listing(metrics: DataFrame, period: str) -> DataFrame:
    c = {"daily": "rog_daily", "weekly": "rog_weekly", "monthly": "rog_monthly"}[period]
    return metrics.where(F.col(c).isNotNull()).select("artist_id", "platform", "date", F.col(c).alias("rog")).orderBy(
        F.col("date").desc(), "artist_id", "platform"
    )


# --- folds over a sorted series ---------------------------------------------------------


def series_arrays(series: DataFrame) -> DataFrame:
    """One sorted ``array<struct<date, x>>`` per series; rows without a value leave their series, if need be with an empty array."""
    point = F.when(F.col("x").isNotNull(), F.struct("date", "x"))
    return series.groupBy(*SERIES).agg(F.array_sort(F.collect_list(point)).alias("pts"))


def _ema(prev: Column, x: Column, alpha: float) -> Column:
    return F.lit(alpha) * x + F.lit(1 - alpha) * prev


def smooth(series: DataFrame, alpha: float = 0.3, days: int = 128) -> DataFrame:
    """Exponential smoothing: the first value as is, then ``alpha*x + (1-alpha)*s``.

    A blocked scan: a step is an affine map of the level before, so a block of ``days`` calendar days is one as well.
    Every block is scanned from level 0, its map (factor and last level) becomes one row, the maps of a series are chained, and
    each block adds the decayed level it starts with.  Blocks are independent, so a long series spreads over tasks.
    """
    keep = 1.0 - alpha
    block = F.floor(F.datediff("date", F.lit("1970-01-01").cast("date")) / days)
    within = W.partitionBy(*SERIES, "block").orderBy("date")
    nth = F.row_number().over(within).cast("double")
    # a block has at most `days` rows, so the powers stay far from the limits of a double
    rows = series.select(*SERIES, "date", "x", block.alias("block")).withColumn("nth", nth)
    scanned = rows.withColumn("own", F.sum(alpha * F.col("x") * F.pow(F.lit(keep), -F.col("nth"))).over(within) * F.pow(F.lit(keep), "nth"))
    blocks = scanned.groupBy(*SERIES, "block").agg(F.max_by("own", "date").alias("last"), F.count("*").alias("n"), F.min_by("x", "date").alias("x0"))
    maps = blocks.groupBy(*SERIES).agg(F.array_sort(F.collect_list(F.struct("block", "last", "n", "x0"))).alias("maps"))
    # the level before the first value is that value, which leaves it as it is
    zero = F.struct(F.col("maps")[0].x0.alias("level"), F.array().cast("array<struct<block:bigint,start:double>>").alias("out"))
    step = lambda acc, m: F.struct(
        (m.last + acc.level * F.pow(F.lit(keep), m.n.cast("double"))).alias("level"),
        F.array_append(acc.out, F.struct(m.block.alias("block"), acc.level.alias("start"))).alias("out"),
    )
    starts = maps.select(*SERIES, F.explode(F.aggregate("maps", zero, step)["out"]).alias("b")).select(*SERIES, "b.block", "b.start")
    level = F.col("own") + F.col("start") * F.pow(F.lit(keep), "nth")
    return scanned.join(starts, [*SERIES, "block"]).select(*SERIES, "date", "x", level.alias("s"))


def _fold(pts: Column, alpha: float) -> Column:
    """One pass: smoothed level, twice-smoothed last three values, residual moments."""
    d = lambda v: F.lit(float(v))
    x0 = F.element_at(pts, 1).x
    zero = F.struct(
        x0.alias("s"), x0.alias("u"), d(0).alias("u1"), d(0).alias("u2"),
        d(1).alias("n"), d(0).alias("mean"), d(0).alias("m2"), d(0).alias("r"),
    )

    def step(a: Column, p: Column) -> Column:
        s = _ema(a.s, p.x, alpha)
        r, n = p.x - s, a.n + 1
        mean = a.mean + (r - a.mean) / n
        return F.struct(
            s.alias("s"), _ema(a.u, s, alpha).alias("u"), a.u.alias("u1"), a.u1.alias("u2"),
            n.alias("n"), mean.alias("mean"), (a.m2 + (r - a.mean) * (r - mean)).alias("m2"), r.alias("r"),
        )

    return F.aggregate(F.slice(pts, 2, F.greatest(F.size(pts) - 1, F.lit(0))), zero, step)


def _forecast(f: Column, steps: int) -> Column:
    line = F.greatest(F.lit(0.0), f.u + (f.u - f.u2) / 2.0 * steps)
    return half_even(F.when(f.n < 3, f.u).otherwise(line), 2)


def forecast(series: DataFrame, horizons=(30, 90, 180), alpha: float = 0.3) -> DataFrame:
    """Linear continuation of the twice-smoothed series, floored at 0."""
    f = series_arrays(series).select(*SERIES, _fold(F.col("pts"), alpha).alias("f"))
    return f.select(*SERIES, *[_forecast(F.col("f"), h).alias(f"forecast_{h}d") for h in horizons])


def _anomaly(f: Column, sigma: float) -> Column:
    std = F.sqrt(f.m2 / F.greatest(f.n - 1, F.lit(1.0)))
    z = F.abs(f.r) / F.when(std > 0, std)
    return F.when((f.n >= 7) & (std > 0), z > sigma).otherwise(F.lit(False))


def anomalies(series: DataFrame, sigma: float = 3.0, alpha: float = 0.3) -> DataFrame:
    """Is the last residual from the smoothed level more than ``sigma`` sample deviations?"""
    f = series_arrays(series).select(*SERIES, _fold(F.col("pts"), alpha).alias("f"))
    return f.select(*SERIES, F.col("f.n").cast("long").alias("points"), half_up(F.col("f.r"), 4).alias("last_residual"),
                    _anomaly(F.col("f"), sigma).alias("anomaly"))


# values that one batch of series may hold with its padding, so a long series stands alone
_BATCH_VALUES = 1 << 19


def _batches(xs: pd.Series, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Series of like length side by side: (places in ``xs``, lengths, values by day and series), longest first."""
    sizes = np.array([len(x) for x in xs], np.int64)
    order = np.argsort(-sizes, kind="stable")
    at = 0
    while at < len(order):
        longest = max(1, int(sizes[order[at]]))
        places = order[at : at + max(1, min(rows, _BATCH_VALUES // longest))]
        at += len(places)
        table = np.zeros((longest, len(places)))
        for j, i in enumerate(places.tolist()):
            table[: sizes[i], j] = xs.iloc[i]
        yield places, sizes[places], table


def _smoothed(table: np.ndarray, alpha: float) -> np.ndarray:
    """``ewm(alpha, adjust=False).mean()`` of every column, all columns a day at a time."""
    if np.isnan(table).any():
        return pd.DataFrame(table).ewm(alpha=alpha, adjust=False).mean().to_numpy()
    out, level = np.empty_like(table), table[0]
    for day, x in enumerate(table):
        level = np.where(level == x, level, ((1.0 - alpha) * level + alpha * x) / ((1.0 - alpha) + alpha))
        out[day] = level
    return out


def forecast_holt(series: DataFrame, horizons=(30, 90, 180), alpha: float = 0.3) -> DataFrame:
    """Holt linear trend on the twice-smoothed series, level and trend weights by grid search.

    A task takes some series at once, so a step over the days serves all of them and their whole grids.
    """
    grid = np.round(np.arange(0.05, 1.0, 0.05), 2)
    a, b = (g.ravel() for g in np.meshgrid(grid, grid, indexing="ij"))

    def fit(sizes: np.ndarray, table: np.ndarray) -> np.ndarray:
        s = _smoothed(_smoothed(table, alpha), alpha)
        n = len(sizes)
        last = s[np.maximum(sizes, 1) - 1, np.arange(n)]
        if len(s) < 3:
            return np.repeat(last[:, None], len(horizons), axis=1)
        level, trend = np.repeat(s[0][:, None], a.size, axis=1), np.repeat((s[1] - s[0])[:, None], a.size, axis=1)
        sse, bias = np.zeros((n, a.size)), np.zeros((n, a.size))
        for day in range(1, len(s)):
            m = int((sizes > day).sum())  # the longest come first
            guess = level[:m] + trend[:m]
            err = s[day, :m, None] - guess
            bias[:m] += err
            new = guess + a * err
            err *= err
            sse[:m] += err
            trend[:m] = b * (new - level[:m]) + (1 - b) * trend[:m]
            level[:m] = new
        row, best = np.arange(n), np.argmin(sse, axis=1)
        shift = bias[row, best] / np.maximum(sizes - 1, 1)
        ahead = np.stack([level[row, best] + h * trend[row, best] + shift for h in horizons], axis=1)
        return np.where((sizes < 3)[:, None], last[:, None], np.where(ahead > 0, ahead, 0.0))

    @F.pandas_udf("array<double>")
    def fitted(xs: pd.Series) -> pd.Series:
        out = np.empty((len(xs), len(horizons)))
        for places, sizes, table in _batches(xs, 16):
            out[places] = fit(sizes, table)
        return pd.Series(list(out), dtype=object)

    f = series_arrays(series).select(*SERIES, fitted(F.col("pts.x")).alias("f"))
    return f.select(*SERIES, *[F.col("f")[i].alias(f"forecast_{h}d") for i, h in enumerate(horizons)])


# series up to this length have the table of all their pairs in memory
_SHORT = 512


def median_square_gap(x: np.ndarray) -> float:
    """Median of the squared differences of all pairs, in memory linear in the values.

    The k-th smallest difference is found by bisection over the floats: counting the pairs below a bound takes one
    search per value.  A short series has its differences in one table.
    """
    x = np.sort(x)
    n = len(x)
    if n <= _SHORT:
        gaps = (x[None, :] - x[:, None])[np.arange(n)[:, None] < np.arange(n)]
        low, high = (len(gaps) - 1) // 2, len(gaps) // 2
        gaps = np.partition(gaps, (low, high))
        return (float(gaps[low]) ** 2 + float(gaps[high]) ** 2) / 2
    pairs = n * (n - 1) // 2
    after = np.arange(1, n + 1)

    def kth(k: int) -> float:
        low, high = 0, int(np.array(x[-1] - x[0]).view(np.int64))  # non-negative floats are ordered like their bits
        while low < high:
            mid = (low + high) // 2
            bound = np.array(mid, np.int64).view(np.float64)
            if int((np.searchsorted(x, x + bound, "right") - after).sum()) > k:
                high = mid
            else:
                low = mid + 1
        return float(np.array(low, np.int64).view(np.float64)) ** 2

    return (kth((pairs - 1) // 2) + kth(pairs // 2)) / 2


def _short_change_points(x: np.ndarray, scale: float, penalty: float, min_size: int, jump: int) -> list[int]:
    """``change_points`` with the kernel of all pairs as one table; the same sums in the same order."""
    n = len(x)
    ends = [e for e in range(0, n, jump) if e >= min_size] + [n]
    starts = np.array([0, *ends[:-1]])
    gap = x[:, None] - x[None, :]
    kernel = np.tril(np.exp(-np.clip(gap * gap * scale, 1e-2, 1e2)), -1)
    tail = np.cumsum(kernel[:, ::-1], axis=1)[:, ::-1][:, starts]
    total = np.cumsum(np.where(np.arange(n)[:, None] >= starts, 2 * tail + 1.0, 0.0), axis=0)
    stops = np.array(ends)
    length = (stops[:, None] - starts).astype(float)
    ready = length >= min_size
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = total[stops - 1] / length
    best, back, live = np.zeros(len(starts) + 1), [0] * (len(ends) + 1), np.zeros(len(starts), bool)
    live[0] = True
    for i in range(len(ends)):
        k = i + 1  # the starts before this end; best[j] belongs to starts[j]
        usable = ready[i, :k] & live[:k]
        if not usable.any():
            continue
        trial = np.where(usable, best[:k] + length[i, :k] - mean[i, :k] + penalty, np.inf)
        win = int(np.argmin(trial))
        best[k], back[k] = trial[win], win
        live[:k] &= ~ready[i, :k] | (trial <= best[k] + penalty)
        if k < len(starts):
            live[k] = True
    cuts, at = [], len(ends)
    while back[at] > 0:
        at = back[at]
        cuts.append(int(starts[at]))
    return sorted(cuts)


def change_points(x: np.ndarray, penalty: float, min_size: int = 2, jump: int = 5) -> list[int]:
    """Exact penalised segmentation with pruning under a Gaussian-kernel cost.

    For every start that is still in play the sum of the kernel over its segment grows with the end, so the memory is
    linear in the values; a start is dropped for good once it cannot win any more.
    """
    n = len(x)
    med = median_square_gap(x)
    scale = 1.0 / med if med else 1.0
    if n <= _SHORT:
        return _short_change_points(x, scale, penalty, min_size, jump)
    starts, total = np.zeros(1, np.int64), np.zeros(1)  # the starts in play and the kernel sums from each to the end so far
    best, back, reached = {0: 0.0}, {}, 0
    for end in [e for e in range(0, n, jump) if e >= min_size] + [n]:
        for p in range(reached, end):
            seen = x[starts[0] : p] - x[p]
            k = np.exp(-np.clip(seen * seen * scale, 1e-2, 1e2))
            tail = np.append(np.cumsum(k[::-1])[::-1], 0.0)  # kernel with all values from each place to p
            inside = starts <= p
            total[inside] += 2 * tail[starts[inside] - starts[0]] + 1.0
        reached = end
        ready = end - starts >= min_size
        length = (end - starts).astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            trial = np.where(ready, np.array([best[t] for t in starts.tolist()]) + length - total / length + penalty, np.inf)
        if not ready.any():
            continue
        win = int(np.argmin(trial))
        best[end], back[end] = float(trial[win]), int(starts[win])
        live = ~ready | (trial <= best[end] + penalty)
        starts, total = np.append(starts[live], end), np.append(total[live], 0.0)
    cuts, at = [], n
    while back.get(at, 0) > 0:
        at = back[at]
        cuts.append(at)
    return sorted(cuts)


def _cuts(xs: Column, penalty: float = 5.0, alpha: float = 0.3) -> Column:
    """Places (from 0) in a sorted array of values where its smoothed series changes regime; none below 14 points."""

    @F.pandas_udf("array<int>")
    def find(xs: pd.Series) -> pd.Series:
        out = np.empty(len(xs), object)
        for places, sizes, table in _batches(xs, 1024):
            smoothed = _smoothed(table, alpha)
            for j, (place, size) in enumerate(zip(places.tolist(), sizes.tolist())):
                out[place] = change_points(smoothed[:size, j].copy(), penalty) if size >= 14 else []
        return pd.Series(out)

    return find(xs)


def breakpoints(series: DataFrame, penalty: float = 5.0, alpha: float = 0.3) -> DataFrame:
    """Dates where the smoothed series changes regime, for series of 14 points or more."""
    found = series_arrays(series).select(*SERIES, F.col("pts.date").alias("days"), _cuts(F.col("pts.x"), penalty, alpha).alias("cuts"))
    return found.select(*SERIES, F.explode(F.transform("cuts", lambda i: F.element_at("days", i + 1))).alias("date"))


# --- growth summaries -------------------------------------------------------------------


def trend_class(r30: Column, r90: Column) -> Column:
    return (
        F.when((r30 > 5) | (r90 > 10), "rising").when((r30 < -5) | (r90 < -10), "declining").otherwise("stable")
    )


def cross_platform_score(growth: DataFrame) -> DataFrame:
    """Weighted mean of squashed 30-day growth over platforms with three points or more."""
    w = lookup.exact(F.col("platform"), GROWTH_WEIGHTS, 0.05)
    used = F.col("points") >= 3
    score = F.lit(50.0) + F.lit(50.0) * F.tanh(F.col("rog_30d") / 20.0)
    return growth.groupBy("artist_id").agg(
        half_even(F.coalesce(F.try_divide(F.sum(F.when(used, w * score)), F.sum(F.when(used, w))), F.lit(50.0)), 2).alias("cross_platform_score")
    )


def best_growth(growth: DataFrame) -> DataFrame:
    return growth.where(F.col("platform").isin(PLATFORMS)).groupBy("artist_id").agg(F.greatest(F.lit(0.0), F.max("rog_30d")).alias("best_rog_30d"))


def social_velocity(series: DataFrame, days: int = 14) -> DataFrame:
    """Growth over the artist's last ``days`` days summed over platforms, on a log scale to 1.

    Partitioned by artist once; the per-platform step reuses that partitioning.
    """
    dated = series.withColumn("last", F.max("date").over(W.partitionBy("artist_id")))
    per = (
        dated.where(F.col("date") >= F.date_sub("last", days))
        .groupBy(*SERIES)
        .agg(F.count(F.lit(1)).alias("n"), (F.max_by("x", "date") - F.min_by("x", "date")).alias("gain"))
    )
    known = F.col("platform").isin(PLATFORMS) & (F.col("n") >= 2)
    gain = F.coalesce(F.sum(F.when(known, F.col("gain"))), F.lit(0.0))
    return per.groupBy("artist_id").agg(gain.alias("gain")).select(
        "artist_id",
        F.when(F.col("gain") > 0, F.least(F.lit(1.0), F.log1p(F.greatest("gain", F.lit(0.0))) / F.log1p(F.lit(1e6)))).otherwise(F.lit(0.0)).alias("social_velocity"),
    )


def latest_metrics(metrics: DataFrame) -> DataFrame:
    rest = [c for c in metrics.columns if c not in (*SERIES, "date")]
    return metrics.groupBy(*SERIES).agg(F.max_by(F.struct("date", *rest), "date").alias("m")).select(*SERIES, "m.*")


def last_n(metrics: DataFrame, n: int) -> DataFrame:
    """Newest n rows per artist.  Spark limits each group in every task before the shuffle."""
    w = W.partitionBy("artist_id").orderBy(F.col("date").desc(), "platform")
    return metrics.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def artist_momentum(metrics: DataFrame) -> DataFrame:
    """Mean non-zero daily growth over the last 30 rows, scaled around 50."""
    vals = [F.coalesce("rog_daily", F.lit(0.0)), F.coalesce("rog_weekly", F.lit(0.0)) / 7, F.coalesce("rog_monthly", F.lit(0.0)) / 30]
    total, n = F.lit(0.0), F.lit(0)
    for x in vals:
        total, n = total + x, n + F.when(x != 0, 1).otherwise(0)
    per = last_n(metrics, 30).groupBy("artist_id").agg(F.sum(total).alias("t"), F.sum(n).alias("n"))
    return per.select("artist_id", F.when(F.col("n") == 0, F.lit(50.0)).otherwise(clamp(F.lit(50.0) + F.try_divide("t", "n") * 9, 0, 100)).alias("artist_momentum"))


def engagement_velocity(metrics: DataFrame) -> DataFrame:
    """Weighted engagement of the newest against the oldest of the last 14 rows."""
    e = F.col("likes") + F.col("comments") * 2 + F.col("shares") * 3 + F.col("streams") * 0.1
    per = last_n(metrics, 14).withColumn("e", e).groupBy("artist_id").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("e", "rn").alias("new"), F.max_by("e", "rn").alias("old"))
    growth = (F.col("new") - F.col("old")) / F.when(F.col("old") > 0, F.col("old"))
    return per.select("artist_id", F.when(F.col("n") < 2, F.lit(50.0)).when(F.col("old") <= 0, F.lit(55.0))
                      .otherwise(clamp(F.lit(50.0) + growth * 45, 0, 100)).alias("engagement_velocity"))


def trend_matrix(metrics: DataFrame, platforms=tuple(PLATFORMS)) -> DataFrame:
    """One row per month, one column per platform, missing as 0."""
    value = F.when(F.col("platform").isin(STREAM_PLATFORMS), F.col("streams")).otherwise(F.col("followers"))
    return metrics.groupBy(F.trunc("date", "month").alias("month")).pivot("platform", list(platforms)).agg(F.sum(value)).fillna(0)


def profile_trend(metrics: DataFrame, keep: str = "first", platforms=tuple(PLATFORMS)) -> DataFrame:
    """One follower value per artist, month and platform: the earliest or the latest of the month."""
    pick = F.min_by if keep == "first" else F.max_by
    return (
        metrics.groupBy("artist_id", F.trunc("date", "month").alias("month")).pivot("platform", list(platforms))
        .agg(pick("followers", "date")).fillna(0)
    )


def synthesize_metrics(artists: DataFrame, as_of: Column | str, mode: str = "training", days: list[int] | None = None) -> DataFrame:
    """Back-history made from snapshot columns; every day of it, or only ``days`` before ``as_of``.

    ``training``: 90 days before ``as_of``, growing 8 %, counts truncated, only platforms with a
    value.  ``serving``: 14 days up to ``as_of``, 0.6 % a day, counts rounded, with defaults for
    the three main platforms when unknown.
    """
    day = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    keep = [c for c in artists.columns if c not in SNAPSHOT_COLUMNS.values()]
    default = {"spotify": 50_000, "instagram": 30_000, "youtube": 20_000} if mode == "serving" else {}
    seeds = F.array(*[
        F.struct(F.lit(p).alias("platform"), F.coalesce(F.col(c), F.lit(default.get(p, 0))).cast("double").alias("seed"),
                 F.lit(p in ("spotify", "youtube")).alias("has_streams"))
        for p, c in SNAPSHOT_COLUMNS.items()
    ])
    live = F.filter(seeds, lambda s: s.seed > 0)
    fallback = F.array(F.struct(F.lit("spotify").alias("platform"), F.lit(50_000.0).alias("seed"), F.lit(True).alias("has_streams")))
    n, first = (90, 1) if mode == "training" else (13, 0)
    # some hundred rows come out of each artist: the few files of the artists are dealt over all tasks first
    tasks = max(int(artists.sparkSession.conf.get("spark.sql.shuffle.partitions")), artists.sparkSession.sparkContext.defaultParallelism)
    rows = artists.repartition(tasks).select(*keep, day.alias("end_day"), F.explode(F.when(F.size(live) > 0, live).otherwise(fallback)).alias("s"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(first), F.lit(n)) if days is None else F.array(*map(F.lit, days))).alias("off"))
    factor = F.lit(1.0) - (F.col("off") / 90.0) * 0.08 if mode == "training" else F.lit(1.0) - F.col("off") * 0.006
    cut = (lambda c: F.floor(c).cast("long")) if mode == "training" else (lambda c: half_up(c).cast("long"))
    base = F.col("s.seed") * factor
    stream_like = F.when(F.col("s.has_streams"), base).otherwise(F.lit(0.0))
    video = F.col("s.platform") == "youtube"
    # serving rows carry streams for spotify and views for youtube only
    streams = stream_like if mode == "training" else F.when(video, F.lit(0.0)).otherwise(stream_like)
    views = F.when(video, base).otherwise(F.lit(0.0)) if mode == "training" else stream_like
    return rows.select(
        *keep, F.col("s.platform").alias("platform"), F.date_sub("end_day", F.col("off")).alias("date"),
        cut(base).alias("followers"), cut(streams).alias("streams"), cut(views).alias("views"),
        cut(base * 0.01).alias("likes"), cut(base * 0.001).alias("comments"), cut(base * 0.0005).alias("shares"),
    )


def growth_report(metrics: DataFrame, with_breakpoints: bool = True) -> DataFrame:
    """Per artist: an entry per platform, the cross-platform score and the break dates.

    Every per-series number comes from one sorted array, so the whole report shuffles the
    metrics once by series and once more, tiny, by artist.
    """
    arr = series_arrays(metrics.select(*SERIES, "date", _leading().alias("x")))
    known = F.size("pts") >= 3
    cuts = _cuts(F.col("pts.x")) if with_breakpoints else F.array().cast("array<int>")
    arr = arr.select(*SERIES, "pts", F.when(known, _fold(F.col("pts"), 0.3)).alias("f"), cuts.alias("cuts"))
    last = F.try_element_at("pts", F.lit(-1))

    def past(w: int) -> Column:
        older = F.filter("pts", lambda p: p.date <= F.date_sub(last.date, w))
        return F.try_element_at(older, F.lit(-1)).x

    flat = arr.select(
        *SERIES, F.size("pts").alias("points"), last.x.alias("current_value"),
        *[_rate(last.x, past(w), F.size("pts")).alias(f"rog_{w}d") for w in (7, 30, 90)],
        *[_forecast(F.col("f"), h).alias(f"forecast_{h}d") for h in (30, 90, 180)],
        _anomaly(F.col("f"), 3.0).alias("anomaly"), known.alias("known"), F.transform("cuts", lambda i: F.element_at("pts", i + 1).date.cast("string")).alias("cuts"),
    ).withColumn("trend", trend_class(F.col("rog_30d"), F.col("rog_90d")))
    w = F.when(F.col("known"), lookup.exact(F.col("platform"), GROWTH_WEIGHTS, 0.05))
    score = F.lit(50.0) + F.lit(50.0) * F.tanh(F.col("rog_30d") / 20.0)
    entry = F.when(F.col("known"), F.struct(*[c for c in flat.columns if c not in ("artist_id", "known", "cuts")]))
    report = flat.groupBy("artist_id").agg(
        F.coalesce(half_even(F.sum(w * score) / F.sum(w), 2), F.lit(50.0)).alias("cross_platform_score"),
        F.array_sort(F.collect_list(entry)).alias("platforms"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("cuts")))).alias("breakpoints"),
    )
    report = report.withColumn("platforms", F.when(F.size("platforms") > 0, F.col("platforms")))
    return report if with_breakpoints else report.drop("breakpoints")
