"""Cross-sectional factor evaluation over long panels (t, name, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .rolling import finite


def average_rank(x: Column, over_values: WindowSpec, over_all: WindowSpec) -> Column:
    """Rank from 1 with ties at their mean; over_values is ordered by x, over_all has x in its partition."""
    return F.rank().over(over_values) + (F.count(F.lit(1)).over(over_all) - 1) / 2


def _ranked(df: DataFrame, by: list[str], *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(f"rank_{c}", average_rank(F.col(c), Window.partitionBy(*by).orderBy(c), Window.partitionBy(*by, c)))
    return df


def _flat(c: str) -> Column:
    return F.min(c) == F.max(c)


def factor_ic(panel: DataFrame, t: str, f: str, r: str, method: str = "spearman", least: int = 3) -> DataFrame:
    """Correlation of factor and forward return across names on each date: t, ic, n."""
    both = panel.select(F.col(t), finite(F.col(f)).alias("f"), finite(F.col(r)).alias("r")).dropna()
    if method == "spearman":
        both = _ranked(both, [t], "f", "r").select(t, F.col("rank_f").alias("f"), F.col("rank_r").alias("r"))
    elif method == "kendall":
        return both.groupBy(t).applyInPandas(_kendall(t), f"{t} {dict(panel.dtypes)[t]}, ic double, n bigint").filter(F.col("n") >= least)
    elif method != "pearson":
        raise ValueError(f"method {method!r} is not spearman, pearson or kendall")
    out = both.groupBy(t).agg(F.when(~(_flat("f") | _flat("r")), F.corr("f", "r")).alias("ic"), F.count("*").alias("n"))
    return out.filter(F.col("n") >= least)


def _kendall(t: str):
    from ..functions.series import kendall

    def one(pdf):
        import pandas as pd

        return pd.DataFrame({t: pdf[t].iloc[:1], "ic": [kendall(pdf["f"].to_numpy(), pdf["r"].to_numpy())], "n": [len(pdf)]})

    return one


def ic_summary(ic: DataFrame) -> DataFrame:
    """mean, std, t_stat, ir (mean / std x sqrt(n), equal to t_stat), ir_raw, n_periods of daily ics."""
    row = ic.filter("ic IS NOT NULL").agg(F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("std"), F.count("*").alias("n_periods"))
    raw = F.try_divide(F.col("mean"), F.nullif(F.col("std"), F.lit(0.0)))
    return row.select("mean", "std", (raw * F.sqrt("n_periods")).alias("t_stat"), (raw * F.sqrt("n_periods")).alias("ir"), raw.alias("ir_raw"), "n_periods")


def factor_rank_autocorr(panel: DataFrame, t: str, name: str, f: str, lag: int = 1) -> DataFrame:
    """Spearman correlation of each date's factor with that of ``lag`` dates before, across names that have both: t, autocorr, n."""
    days = panel.select(t).distinct().withColumn("_i", F.dense_rank().over(Window.orderBy(t)))  # a row by date
    now = panel.select(t, name, finite(F.col(f)).alias("f")).join(F.broadcast(days), t)
    before = now.select(name, F.col("f").alias("g"), (F.col("_i") + lag).alias("_i"))
    both = now.join(before, [name, "_i"]).dropna()
    both = _ranked(both, [t], "f", "g")
    return both.groupBy(t).agg(F.when(~(_flat("rank_f") | _flat("rank_g")), F.corr("rank_f", "rank_g")).alias("autocorr"), F.count("*").alias("n")).filter("n >= 3")


def quantile_bins(panel: DataFrame, t: str, f: str, n_quantiles: int = 5) -> DataFrame:
    """panel with bin 0 .. n-1 by date: interpolated inner edges, a value on an edge goes up; dates with fewer finite names have none."""
    day = Window.partitionBy(t)
    x = finite(F.col(f))
    staged = panel.withColumn("_edges", F.percentile(x, F.array(*[F.lit(k / n_quantiles) for k in range(1, n_quantiles)])).over(day)).withColumn("_n", F.count(x).over(day))
    above = F.size(F.filter("_edges", lambda e: x >= e))
    return staged.withColumn("bin", F.when(x.isNotNull() & (F.col("_n") >= n_quantiles), above)).drop("_edges", "_n")


def mean_return_by_quantile(panel: DataFrame, t: str, f: str, r: str, n_quantiles: int = 5) -> DataFrame:
    """Mean forward return by date and bin: t, bin, mean_return, n."""
    return quantile_bins(panel, t, f, n_quantiles).filter("bin IS NOT NULL").groupBy(t, "bin").agg(F.avg(finite(F.col(r))).alias("mean_return"), F.count("*").alias("n"))


def quantile_spread(panel: DataFrame, t: str, f: str, r: str, n_quantiles: int = 5) -> DataFrame:
    """Top less bottom bin's mean return by date: t, spread."""
    means = mean_return_by_quantile(panel, t, f, r, n_quantiles)
    pick = lambda k: F.max(F.when(F.col("bin") == k, F.col("mean_return")))
    return means.groupBy(t).agg((pick(n_quantiles - 1) - pick(0)).alias("spread"))


def quantile_turnover(panel: DataFrame, t: str, name: str, f: str, n_quantiles: int = 5) -> DataFrame:
    """Share of the date before's top and bottom members that left: t, top, bottom."""
    binned = quantile_bins(panel, t, f, n_quantiles)
    days = panel.select(t).distinct().withColumn("_i", F.dense_rank().over(Window.orderBy(t)))
    held = binned.filter(F.col("bin").isin(0, n_quantiles - 1)).join(F.broadcast(days), t).select(name, "_i", "bin")
    nxt = held.select(name, (F.col("_i") - 1).alias("_i"), F.col("bin").alias("next_bin"))
    both = held.join(nxt, [name, "_i"], "left").withColumn("left_", (~F.col("next_bin").eqNullSafe(F.col("bin"))).cast("double"))
    part = lambda k: F.avg(F.when(F.col("bin") == k, F.col("left_")))
    out = both.groupBy((F.col("_i") + 1).alias("_i")).agg(part(n_quantiles - 1).alias("top"), part(0).alias("bottom"))
    return out.join(F.broadcast(days), "_i").select(t, "top", "bottom")


def icdecay(df: DataFrame, key: str, t: str, signal: str, ret: str, horizons: tuple[int, ...] = (1, 5, 21, 63)) -> DataFrame:
    """Spearman correlation by key of signal and the sum of the next h returns: key, horizon, ic, ic_stderr, ic_tstat, n."""
    over = Window.partitionBy(key).orderBy(t)
    ahead = [F.when(F.count(F.col(ret)).over(over.rowsBetween(1, h)) == h, F.sum(ret).over(over.rowsBetween(1, h))).alias(f"h{h}") for h in horizons]
    wide = df.select(key, finite(F.col(signal)).alias("f"), *ahead)
    long = wide.select(key, "f", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"h{h}").alias("r")) for h in horizons])).alias("x")).select(key, "f", "x.*").dropna()
    out = _ranked(long, [key, "horizon"], "f", "r").groupBy(key, "horizon").agg(F.corr("rank_f", "rank_r").alias("ic"), F.count("*").alias("n"))
    err = 1.0 / F.sqrt("n")
    return out.select(key, "horizon", "ic", err.alias("ic_stderr"), (F.col("ic") / err).alias("ic_tstat"), "n")


def winsorize(df: DataFrame, by: list[str], x: str, lo: float = 0.01, hi: float = 0.99, out: str = "clipped") -> DataFrame:
    """df with x clipped to quantiles of its group; values that aren't finite stay."""
    group = Window.partitionBy(*by)
    v = finite(F.col(x))
    edges = F.percentile(v, F.array(F.lit(lo), F.lit(hi))).over(group)
    staged = df.withColumn("_e", edges)
    return staged.withColumn(out, F.when(v.isNull(), F.col(x)).otherwise(F.greatest(F.get("_e", 0), F.least(F.get("_e", 1), v)))).drop("_e")


def neutralize(df: DataFrame, by: list[str], y: str, x: str, out: str = "residual") -> DataFrame:
    """df with the residual of y on x and a constant, by group, in one exchange."""
    group = Window.partitionBy(*by)
    ok = finite(F.col(y)).isNotNull() & finite(F.col(x)).isNotNull()
    a, b = F.when(ok, F.col(y)), F.when(ok, F.col(x))
    staged = df.withColumn("_my", F.avg(a).over(group)).withColumn("_mx", F.avg(b).over(group))
    slope = F.try_divide(F.sum((b - F.col("_mx")) * (a - F.col("_my"))).over(group), F.nullif(F.sum((b - F.col("_mx")) * (b - F.col("_mx"))).over(group), F.lit(0.0)))
    return staged.withColumn(out, a - F.col("_my") - slope * (b - F.col("_mx"))).drop("_my", "_mx")


def neutralize_many(df: DataFrame, y: str, factors: list[str], out: str = "residual") -> DataFrame:
    """df with the residual of y on several factors and a constant: normal equations by one aggregation, solved on the driver."""
    import numpy as np

    names = ["1", *factors]
    cols = {"1": F.lit(1.0), **{f: F.col(f) for f in factors}}
    ok = df.filter(finite(F.col(y)).isNotNull())
    for f in factors:
        ok = ok.filter(finite(F.col(f)).isNotNull())
    row = ok.agg(*[F.sum(cols[a] * cols[b]).alias(f"g{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j], *[F.sum(cols[a] * F.col(y)).alias(f"y{i}") for i, a in enumerate(names)]).first()
    k = len(names)
    gram = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    beta = np.linalg.lstsq(gram, np.array([row[f"y{i}"] or 0.0 for i in range(k)]), rcond=None)[0]
    fit = sum((float(b) * cols[n] for b, n in zip(beta, names)), F.lit(0.0))
    return df.withColumn(out, F.col(y) - fit)


def dispersioncollapse(panel: DataFrame, t: str, r: str, window: int = 63, quantile: float = 0.2, n_consecutive: int = 5) -> DataFrame:
    """Dates at which the spread across names has been below its trailing quantile for some dates running: t, dispersion, collapsed."""
    daily = panel.groupBy(t).agg(F.when(F.count(finite(F.col(r))) > 1, F.stddev_samp(finite(F.col(r)))).alias("dispersion"))
    over = Window.orderBy(t)  # a row by date
    trailing = over.rowsBetween(1 - window, 0)
    staged = daily.withColumn("_q", F.when(F.count(F.lit(1)).over(trailing) == window, F.percentile("dispersion", F.lit(quantile)).over(trailing)))
    low = F.coalesce((F.col("dispersion") < F.col("_q")).cast("int"), F.lit(0))
    return staged.withColumn("_low", low).withColumn("collapsed", F.sum("_low").over(over.rowsBetween(1 - n_consecutive, 0)) == n_consecutive).drop("_q", "_low")


def accelerationscan(df: DataFrame, key: str, t: str, x: str, smoothings: list[int]) -> DataFrame:
    """Correlation by key of x and its second difference, smoothed by centred means (which look ahead): key, smoothing, corr, n."""
    over = Window.partitionBy(key).orderBy(t)
    base = df.withColumn("_a", F.col(x) - 2 * F.lag(x).over(over) + F.lag(x, 2).over(over))
    means = []
    for w in smoothings:
        frame = over.rowsBetween(-(w // 2), w // 2)
        means.append(F.struct(F.lit(w).alias("smoothing"), F.when(F.count("_a").over(frame) == 2 * (w // 2) + 1, F.avg("_a").over(frame)).alias("a")))
    long = base.select(key, x, *[m.alias(f"_m{i}") for i, m in enumerate(means)]).select(key, x, F.inline(F.array(*[F.col(f"_m{i}") for i in range(len(means))])))
    return long.filter("a IS NOT NULL").groupBy(key, "smoothing").agg(F.corr("a", x).alias("corr"), F.count("*").alias("n"))
