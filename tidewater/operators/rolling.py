"""Strict rolling windows over ordered series.

Every builder takes columns, a window length and ``over``, a window
specification by key and order *without* a frame, and returns a Column.  A
result is null unless the frame holds ``w`` rows with finite values.  All
builders of one specification share one sort and one Window operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def _frame(over: WindowSpec, w: int) -> WindowSpec:
    if w < 1:
        raise ValueError("window must be 1 or more")
    return over.rowsBetween(1 - w, 0)


def strict(x: Column, w: int, over: WindowSpec, value: Column) -> Column:
    return F.when(F.count(x).over(_frame(over, w)) == w, value)


def rollsum(x, w, over):
    return strict(x, w, over, F.sum(x).over(_frame(over, w)))


def rollmean(x, w, over):
    return strict(x, w, over, F.avg(x).over(_frame(over, w)))


def rollmin(x, w, over):
    return strict(x, w, over, F.min(x).over(_frame(over, w)))


def rollmax(x, w, over):
    return strict(x, w, over, F.max(x).over(_frame(over, w)))


def rollrange(x, w, over):
    return rollmax(x, w, over) - rollmin(x, w, over)


def rollstd(x, w, over, ddof=1):
    if ddof >= w:
        return F.lit(None).cast("double")
    f = _frame(over, w)
    value = F.stddev_samp(x).over(f) if ddof == 1 else F.stddev_pop(x).over(f) * (w / (w - ddof)) ** 0.5
    return strict(x, w, over, value)


def zscore(x, w, over, ddof=1):
    return F.try_divide(x - rollmean(x, w, over), F.nullif(rollstd(x, w, over, ddof), F.lit(0.0)))


def rollskew(x, w, over):
    return strict(x, w, over, F.skewness(x).over(_frame(over, w)) * ((w * (w - 1)) ** 0.5 / (w - 2)))


def rollkurt(x, w, over):
    return strict(x, w, over, (w - 1) / ((w - 2) * (w - 3)) * ((w + 1) * (F.kurtosis(x).over(_frame(over, w)) + 3) - 3 * (w - 1)))


def rollquantile(x, w, over, q):
    if not 0 <= q <= 1:
        raise ValueError("q must be in [0, 1]")
    return strict(x, w, over, F.percentile(x, F.lit(float(q))).over(_frame(over, w)))


def rollmedian(x, w, over):
    return rollquantile(x, w, over, 0.5)


def rollpercentile(x, w, over, p):
    return rollquantile(x, w, over, p / 100)


def _values(x, w, over):
    return F.collect_list(x).over(_frame(over, w))


def rollrank(x, w, over, pct=False):
    a = _values(x, w, over)
    rank = F.size(F.filter(a, lambda v: v < x)) + (F.size(F.filter(a, lambda v: v == x)) + 1) / 2
    return strict(x, w, over, rank / w if pct else rank)


def rollargmax(x, w, over):
    a = _values(x, w, over)
    return strict(x, w, over, (F.array_position(a, F.array_max(a)) - 1).cast("long"))


def rollargmin(x, w, over):
    a = _values(x, w, over)
    return strict(x, w, over, (F.array_position(a, F.array_min(a)) - 1).cast("long"))


def _median(a: Column) -> Column:
    s, n = F.sort_array(a), F.size(a)
    return (F.get(s, ((n - 1) / 2).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2


def rollmad(x, w, over):
    """Median absolute deviation from the frame's median, not scaled."""
    a = _values(x, w, over)
    centre = F.percentile(x, F.lit(0.5)).over(_frame(over, w))
    return strict(x, w, over, _median(F.transform(a, lambda v: F.abs(v - centre))))


def rollmdd(x, w, over):
    """Deepest drawdown (0 or less) of the compounded returns in the frame; a peak before the first return doesn't count."""
    start = F.struct(F.lit(1.0).alias("eq"), F.lit(0.0).alias("peak"), F.lit(0.0).alias("dd"))

    def step(s, r):
        eq = s["eq"] * (1.0 + r)
        peak = F.greatest(s["peak"], eq)
        return F.struct(eq.alias("eq"), peak.alias("peak"), F.least(s["dd"], eq / peak - 1.0).alias("dd"))

    return strict(x, w, over, F.aggregate(_values(x, w, over), start, step, lambda s: s["dd"]))


def rollcalmar(x, w, over, ann_factor=1.0):
    return F.try_divide(rollmean(x, w, over) * ann_factor, F.nullif(F.abs(rollmdd(x, w, over)), F.lit(0.0)))


def rollsharpe(x, w, over, ann_factor=1.0, rf=0.0, ddof=1):
    return F.try_divide((rollmean(x, w, over) - rf) * ann_factor**0.5, F.nullif(rollstd(x, w, over, ddof), F.lit(0.0)))


def rollsortino(x, w, over, ann_factor=1.0, target=0.0):
    down = F.least(x - target, F.lit(0.0))
    below = F.when(x.isNotNull(), down * down)
    return F.try_divide((rollmean(x, w, over) - target) * ann_factor**0.5, F.nullif(F.sqrt(rollmean(below, w, over)), F.lit(0.0)))


def rolltailindex(x, w, over, k_frac=0.1, min_k=10):
    """Hill's index of the positive values in the frame."""
    a = F.sort_array(F.filter(_values(x, w, over), lambda v: v > 0), asc=False)
    k = F.greatest(F.lit(min_k), F.ceil(k_frac * F.size(a)).cast("int"))
    top = F.aggregate(F.slice(a, 1, k), F.lit(0.0), lambda s, v: s + F.log(v))
    return strict(x, w, over, F.when(F.size(a) > k, top / k - F.log(F.get(a, k))))


def _pair(x, y):
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, x), F.when(both, y)


def rollcov(x, y, w, over, ddof=1):
    x, y = _pair(x, y)
    f = _frame(over, w)
    return strict(x, w, over, F.covar_samp(x, y).over(f) if ddof == 1 else F.covar_pop(x, y).over(f) * (w / (w - ddof)))


def rollcorr(x, y, w, over):
    x, y = _pair(x, y)
    f = _frame(over, w)
    flat = (F.max(x).over(f) == F.min(x).over(f)) | (F.max(y).over(f) == F.min(y).over(f))
    return strict(x, w, over, F.when(~flat, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.corr(x, y).over(f)))))


def rollbeta(x, y, w, over):
    """Slope of y on x."""
    x, y = _pair(x, y)
    f = _frame(over, w)
    return strict(x, w, over, F.try_divide(F.covar_samp(x, y).over(f), F.nullif(F.var_samp(x).over(f), F.lit(0.0))))


def rollidio(y, x, w, over, ddof=1):
    """Volatility of y that x doesn't explain; a share of less than 1e-12 of the variance is rounding and counts as none."""
    rho = rollcorr(x, y, w, over)
    rest = 1.0 - rho * rho
    return rollstd(y, w, over, ddof) * F.when(rest >= 1e-12, F.sqrt(rest)).when(rest.isNotNull(), F.lit(0.0))


def true_range(high, low, close, over):
    """Of each bar; the first bar's is high - low."""
    before = F.lag(close).over(over)
    return F.when(F.row_number().over(over) == 1, high - low).when(before.isNotNull() & high.isNotNull() & low.isNotNull(), F.greatest(high - low, F.abs(high - before), F.abs(low - before)))


def atr(df: DataFrame, high: str, low: str, close: str, w: int, over: WindowSpec, out: str = "atr") -> DataFrame:
    """df with the mean true range of w bars."""
    ranged = df.withColumn("_range", true_range(F.col(high), F.col(low), F.col(close), over))
    return ranged.withColumn(out, rollmean(F.col("_range"), w, over)).drop("_range")


def _with(df: DataFrame, out: str) -> StructType:
    return StructType([*df.schema.fields, StructField(out, DoubleType())])


def _alpha(span, alpha):
    if (span is None) == (alpha is None):
        raise ValueError("give either span or alpha")
    return 2 / (span + 1) if alpha is None else alpha


def rollema(df: DataFrame, key: str, order: str, x: str, span=None, alpha=None, out: str = "ema") -> DataFrame:
    """df with the exponential mean of x by key, seeded with the first value; null from the first null on.

    A recursion: each key's rows are folded in order by one task, in batches of
    Arrow; keys are independent.
    """
    a = _alpha(span, alpha)

    def fold(pdf):
        pdf = pdf.sort_values(order, kind="stable")
        e = pdf[x].ewm(alpha=a, adjust=False).mean()
        pdf[out] = e.where(~pdf[x].isna().cummax())
        return pdf

    return df.groupBy(key).applyInPandas(fold, _with(df, out))


def rollemastd(df: DataFrame, key: str, order: str, x: str, span=None, alpha=None, bias=False, out: str = "ema_std") -> DataFrame:
    """df with the exponential standard deviation of x by key, from first and second moments about the first value."""
    import numpy as np

    a = _alpha(span, alpha)

    def fold(pdf):
        pdf = pdf.sort_values(order, kind="stable")
        v = pdf[x] - (pdf[x].iloc[0] if len(pdf) else 0.0)
        m1, m2 = v.ewm(alpha=a, adjust=False).mean(), (v * v).ewm(alpha=a, adjust=False).mean()
        var = np.maximum(m2 - m1 * m1, 0.0)
        if not bias:
            t = np.arange(len(v))
            squares = (1 - a) ** (2 * t) + a * a * (1 - (1 - a) ** (2 * t)) / (1 - (1 - a) ** 2) if a < 1 else np.ones(len(v))
            rest = 1 - squares
            var = np.where(rest > 1e-15, var / np.where(rest > 1e-15, rest, 1.0), np.nan)
        pdf[out] = np.where(v.isna().cummax(), np.nan, np.sqrt(var))
        return pdf

    return df.groupBy(key).applyInPandas(fold, _with(df, out))
