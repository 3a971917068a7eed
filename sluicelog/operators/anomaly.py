"""Outliers of one variable, and of seasonal series."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship


def gaussian(df: DataFrame, value: str, times: float = 3.0) -> DataFrame:
    """Rows further than ``times`` population standard deviations from the mean. NULL values are in no row."""
    x = F.col(value).cast("double")
    stats = df.agg(F.avg(x).alias("m"), F.stddev_pop(x).alias("s"))
    mean, spread = stats.select("m").scalar(), stats.select("s").scalar()
    return df.where((x > mean + times * spread) | (x < mean - times * spread))


def boxplot(df: DataFrame, value: str, times: float = 3.0) -> DataFrame:
    """Rows further than ``times`` interquartile ranges outside the quartiles, which are values of the data.

    Up to about a million different values the quartiles are exact (the least
    value at or above a quarter and three quarters); beyond, their ranks are off
    by at most a millionth of the rows, from sketches that merge over tasks.
    """
    x = F.col(value).cast("double")
    quartiles = df.agg(F.percentile_approx(x, [0.25, 0.75], 1_000_000).alias("q"))
    low, high = quartiles.select(F.col("q")[0]).scalar(), quartiles.select(F.col("q")[1]).scalar()
    return df.where((x > high + times * (high - low)) | (x < low - times * (high - low)))


def _beta_fraction(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz), all arguments side by side."""
    tiny = 1e-300
    safe = lambda y: np.where(np.abs(y) > tiny, y, tiny)
    c, d = np.ones_like(x), 1.0 / safe(1.0 - (a + b) * x / (a + 1.0))
    out = d
    for m in range(1, 400):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1.0 / safe(1.0 + numerator * d), safe(1.0 + numerator / c)
            out = out * d * c
        if (np.abs(d * c - 1.0) < 1e-15).all():
            break
    return out


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def incomplete_beta(x: float | np.ndarray, a: float | np.ndarray, b: float | np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function."""
    x, a, b = (y.astype(float) for y in np.broadcast_arrays(*map(np.asarray, (x, a, b))))
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inner) + b * np.log1p(-inner))
    swap = inner >= (a + 1) / (a + b + 2)
    p, q = np.where(swap, b, a), np.where(swap, a, b)
    part = front * _beta_fraction(np.where(swap, 1 - inner, inner), p, q) / p
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(swap, 1.0 - part, part)))


def student_quantile(p: float | np.ndarray, freedom: float | np.ndarray) -> np.ndarray:
    """Quantiles of Student's t by bisection of its distribution function, side by side."""
    p, freedom = (y.astype(float) for y in np.broadcast_arrays(np.asarray(p), np.asarray(freedom)))
    tail = np.minimum(p, 1 - p)
    above = lambda t: 0.5 * incomplete_beta(freedom / (freedom + t * t), freedom / 2, 0.5)
    low, high = np.zeros_like(tail), np.ones_like(tail)
    while (short := (above(high) > tail) & (high < 1e300)).any():
        low, high = np.where(short, high, low), np.where(short, high * 2, high)
    for _ in range(200):
        mid = (low + high) / 2
        if ((mid == low) | (mid == high)).all():
            break
        more = above(mid) > tail
        low, high = np.where(more, mid, low), np.where(more, high, mid)
    return np.where(p == 0.5, 0.0, np.where(p > 0.5, 1.0, -1.0) * (low + high) / 2)


def generalized_esd(values: np.ndarray, most: int, alpha: float = 0.025, hybrid: bool = True) -> np.ndarray:
    """Positions of up to ``most`` outliers, by the generalized extreme Studentized deviate test.

    ``hybrid`` measures from the median in (unscaled) median absolute
    deviations of the whole sample; otherwise mean and standard deviation are
    taken anew without what was removed before. No spread, no outliers. One
    sort: the farthest value left is the next in distance from the median, or
    the least or greatest of those left.
    """
    n = len(values)
    steps = min(most, n - 2)
    if steps < 1:
        return np.zeros(0, np.int64)
    if hybrid:
        center = np.median(values)
        spread = np.median(np.abs(values - center))
        if not spread > 0:
            return np.zeros(0, np.int64)
        far = np.abs(values - center)
        order = np.argsort(-far, kind="stable")[:steps]
        score = far[order] / spread
    else:
        order, score = _by_mean(values, steps)
        steps = len(order)
        if not steps:
            return order
    i = np.arange(1, steps + 1)
    t = student_quantile(1 - alpha / (2 * (n - i + 1)), n - i - 1)
    bound = (n - i) * t / np.sqrt((n - i - 1 + t * t) * (n - i + 1))
    over = np.flatnonzero(score > bound)
    return order[: over[-1] + 1 if len(over) else 0].astype(np.int64)


def _by_mean(values: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the values farthest from the mean of those left, one after another, and that distance in standard deviations."""
    order = np.argsort(values, kind="stable")
    x = values[order] - values.mean()
    low, high, total, squares = 0, len(x) - 1, float(x.sum()), float(x @ x)
    out, score = [], []
    for _ in range(steps):
        n = high - low + 1
        mean = total / n
        spread = math.sqrt(max(0.0, squares / n - mean * mean))
        if not spread > 1e-12 * max(1.0, abs(mean)):
            break
        under, above = mean - x[low], x[high] - mean
        # of values as far the one that stands first
        first = under > above or (under == above and order[low] < order[high])
        at = low if first else high
        if not first:
            at = low + int(np.searchsorted(x[low : high + 1], x[high], side="left"))
        out.append(order[at])
        score.append(max(under, above) / spread)
        total, squares = total - x[at], squares - x[at] * x[at]
        if first:
            low += 1
        else:
            x[at:high], order[at:high] = x[at + 1 : high + 1], order[at + 1 : high + 1].copy()
            high -= 1
    return np.array(out, np.int64), np.array(score)


def find_period(values: np.ndarray) -> int | None:
    """The lag from 2 to a third of the series of the first autocorrelation peak of the detrended values that is above 0.3 and near the greatest."""
    n = len(values)
    if n < 8:
        return None
    x = values - np.polyval(np.polyfit(np.arange(n), values, 1), np.arange(n))
    energy = float(x @ x)
    if not energy > 0:
        return None
    spectrum = np.fft.rfft(x, 2 * n)
    corr = np.fft.irfft(spectrum * np.conj(spectrum))[: n // 3 + 2] / energy * n / (n - np.arange(n // 3 + 2))
    peaks = [k for k in range(2, n // 3 + 1) if corr[k] > 0.3 and corr[k] >= corr[k - 1] and corr[k] >= corr[k + 1]]
    # multiples of the period peak as well; the first peak near the greatest is meant
    return next((k for k in peaks if corr[k] >= 0.9 * max(corr[p] for p in peaks)), None)


def decompose(values: np.ndarray, period: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Trend and residual.

    The trend is the running median over a period (or a tenth of the series if
    there is none); the season is each phase's median distance from the trend,
    centred on 0. The residual is what remains.
    """
    n = len(values)
    period = period or find_period(values)
    width = max(3, period or n // 10) | 1
    half = width // 2
    if period and n >= 2 * period and half <= period:
        # at the ends the series goes on as a period further in
        padded = np.concatenate((values[period - half : period], values, values[n - period : n - period + half]))
    else:
        padded = np.pad(values, half, mode="reflect" if n > half else "edge")
    trend = np.median(np.lib.stride_tricks.sliding_window_view(padded, width), axis=1)[:n]
    rest = values - trend
    if period and n >= 2 * period:
        phase = np.arange(n) % period
        season = np.array([np.median(rest[phase == k]) for k in range(period)])
        rest = rest - (season - season.mean())[phase]
    return trend, rest


def seasonal_esd(df: DataFrame, time: str, value: str, key: str | None = None, period: int | None = None, alpha: float = 0.025, hybrid: bool = True) -> DataFrame:
    """``key, time, value, trend, residual, outlier`` of each series.

    At most half of a series less one can be outliers. A series is worked on by
    one task, series side by side; its points are aggregates over time, which
    bounds their number. Points without time or value are left out. Without
    ``key`` there is one series, with key NULL.
    """
    ship(df.sparkSession)
    series = df.select((F.col(key).cast("string") if key else F.lit(None).cast("string")).alias("key"), F.col(time).cast("double").alias("time"), F.col(value).cast("double").alias("value")).dropna(subset=["time", "value"])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["time", "value"], kind="stable").reset_index(drop=True)
        x = part["value"].to_numpy(float)
        trend, rest = decompose(x, period)
        out = np.zeros(len(x), bool)
        out[generalized_esd(rest, int(len(x) / 2 - 1), alpha, hybrid)] = True
        return part.assign(trend=trend, residual=rest, outlier=out)

    return series.groupBy("key").applyInPandas(run, "key string, time double, value double, trend double, residual double, outlier boolean")

