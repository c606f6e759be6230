"""Performance, drawdowns, tail risk and tests of return series, by key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.normal import chi2sf, normcdf, normppf
from .rolling import finite


def _over(a: Column, b: Column) -> Column:
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))


def sharperatio(r: Column, ann_factor: float = 252, rf: float = 0.0) -> Column:
    """Aggregate; 0 if the returns hardly vary."""
    x = finite(r)
    return F.when(F.stddev_samp(x) < 1e-15, 0.0).otherwise(F.try_divide((F.avg(x) - rf) * math.sqrt(ann_factor), F.stddev_samp(x)))


def sortinoratio(r: Column, ann_factor: float = 252, target: float = 0.0) -> Column:
    """Aggregate; infinite or 0 without a return below the target."""
    x = finite(r) - target
    down = F.sqrt(F.avg(F.least(x, F.lit(0.0)) * F.least(x, F.lit(0.0))))
    return F.when(F.count(x) == 0, F.lit(None)).when(down < 1e-15, F.signum(F.avg(x)) * F.when(F.avg(x) == 0, 0.0).otherwise(float("inf"))).otherwise(F.try_divide(F.avg(x) * math.sqrt(ann_factor), down))


def omega(r: Column, threshold: float = 0.0) -> Column:
    x = finite(r)
    up, down = F.sum(F.greatest(x - threshold, F.lit(0.0))), F.sum(F.greatest(threshold - x, F.lit(0.0)))
    return F.when(down > 0, up / down).when(up > 0, F.lit(float("inf"))).otherwise(1.0)


def kelly(r: Column, cap: float = 1.0) -> Column:
    x = finite(r)
    return F.when(F.var_samp(x) <= 1e-15, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(cap), F.try_divide(F.avg(x), F.var_samp(x)))))


def up_capture(r: Column, b: Column) -> Column:
    return _over(F.avg(F.when(b > 0, r)), F.avg(F.when(b > 0, b)))


def down_capture(r: Column, b: Column) -> Column:
    return _over(F.avg(F.when(b < 0, r)), F.avg(F.when(b < 0, b)))


def probabilistic_sharpe(sharpe: Column, n: Column, skew: Column, kurt: Column, benchmark: Column | float = 0.0) -> Column:
    bench = benchmark if isinstance(benchmark, Column) else F.lit(float(benchmark))
    spread = 1.0 - skew * sharpe + (kurt - 1.0) / 4.0 * sharpe * sharpe
    return F.when((spread > 0) & (n > 1), normcdf((sharpe - bench) * F.sqrt(n - 1.0) / F.sqrt(F.when(spread > 0, spread).otherwise(1.0))))


def deflated_sharpe(sharpe: Column, n: Column, n_trials: int, variance: Column, skew: Column, kurt: Column) -> Column:
    """Probabilistic Sharpe against the highest of n_trials that luck would give."""
    euler = 0.5772156649015329
    most = F.sqrt(variance) * ((1 - euler) * normppf(F.lit(1 - 1 / n_trials)) + euler * normppf(F.lit(1 - 1 / (n_trials * math.e)))) if n_trials > 1 else F.lit(0.0)
    return probabilistic_sharpe(sharpe, n, skew, kurt, most)


def drawdowns(df: DataFrame, over: WindowSpec, equity: str) -> DataFrame:
    """df with peak and drawdown (0 or less) so far; nulls don't raise the peak."""
    so_far = over.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("peak", F.max(finite(F.col(equity))).over(so_far)).withColumn("drawdown", finite(F.col(equity)) / F.col("peak") - 1.0)


def drawdown(df: DataFrame, key: str, t: str, equity: str) -> DataFrame:
    """The deepest drawdown by key: max_dd, peak_t, trough_t, recovered."""
    over = Window.partitionBy(key).orderBy(t)
    staged = drawdowns(df, over, equity)
    trough = staged.groupBy(key).agg(F.min_by(F.struct(F.col(t).alias("t"), F.col("drawdown").alias("dd"), F.col("peak").alias("peak")), F.struct("drawdown", t)).alias("_low"))
    joined = staged.join(trough, key)
    return joined.groupBy(key).agg(
        F.first("_low.dd").alias("max_dd"),
        F.min(F.when((F.col(equity) == F.col("_low.peak")) & (F.col(t) <= F.col("_low.t")), F.col(t))).alias("peak_t"),
        F.first("_low.t").alias("trough_t"),
        F.coalesce(F.max((F.col(t) > F.col("_low.t")) & (F.col(equity) >= F.col("_low.peak"))), F.lit(False)).alias("recovered"),
    )


def drawdown_table(df: DataFrame, key: str, t: str, equity: str, top_n: int = 5) -> DataFrame:
    """The top_n deepest episodes by key between new highs: peak_t, trough_t, recovery_t, depth, rank."""
    over = Window.partitionBy(key).orderBy(t)
    staged = drawdowns(df.filter(finite(F.col(equity)).isNotNull()), over, equity)
    staged = staged.withColumn("_high", (F.col("drawdown") >= 0).cast("int")).withColumn("_id", F.sum("_high").over(over.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_next", F.lead(t).over(over))
    found = staged.groupBy(key, "_id").agg(F.min(t).alias("peak_t"), F.min_by(t, F.struct("drawdown", t)).alias("trough_t"), F.max_by("_next", t).alias("recovery_t"), F.min("drawdown").alias("depth")).filter("depth < 0")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("depth", "peak_t")))
    return ranked.filter(F.col("rank") <= top_n).select(key, "peak_t", "trough_t", "recovery_t", "depth", "rank")


def ulcer_index(df: DataFrame, key: str, t: str, equity: str) -> DataFrame:
    """Root mean square percentage drawdown and mean log return over it, by key: ulcer, upi."""
    over = Window.partitionBy(key).orderBy(t)
    staged = drawdowns(df, over, equity).withColumn("_g", F.log(F.col(equity) / F.lag(equity).over(over)))
    ulcer = F.sqrt(F.avg(F.pow(100.0 * F.col("drawdown"), 2)))
    return staged.groupBy(key).agg(ulcer.alias("ulcer"), _over(100.0 * F.avg("_g"), ulcer).alias("upi"))


def contribution(df: DataFrame, asset: str, bar: str, group: str, position: str, ret: str) -> DataFrame:
    """Profit by asset, by bar, by group and in all, in one pass of grouping sets: level, asset, bar, group, pnl."""
    pnl = F.coalesce(finite(F.col(position)) * finite(F.col(ret)), F.lit(0.0))
    staged = df.select(F.col(asset).alias("asset"), F.col(bar).alias("bar"), F.col(group).alias("grp"), pnl.alias("pnl"))
    level = F.when(F.grouping("asset") == 0, "asset").when(F.grouping("bar") == 0, "bar").when(F.grouping("grp") == 0, "group").otherwise("total")
    return staged.groupingSets([["asset"], ["bar"], ["grp"], []], "asset", "bar", "grp").agg(level.alias("level"), F.sum("pnl").alias("pnl"))


# -- volatility of bars --------------------------------------------------------


def parkinson(h: Column, l: Column) -> Column:  # noqa: E741
    return F.sqrt(F.avg(F.pow(F.log(h / l), 2)) / (4 * math.log(2)))


def garmanklass(o: Column, h: Column, l: Column, c: Column) -> Column:  # noqa: E741
    return F.sqrt(F.avg(0.5 * F.pow(F.log(h / l), 2) - (2 * math.log(2) - 1) * F.pow(F.log(c / o), 2)))


def rogerssatchell(o: Column, h: Column, l: Column, c: Column) -> Column:  # noqa: E741
    return F.sqrt(F.avg(F.log(h / o) * F.log(h / c) + F.log(l / o) * F.log(l / c)))


def yangzhang(df: DataFrame, key: str, over: WindowSpec, o: str, h: str, l: str, c: str) -> DataFrame:  # noqa: E741
    staged = df.withColumn("_pc", F.lag(c).over(over)).filter("_pc IS NOT NULL")
    O, H, L, C = (F.col(x) for x in (o, h, l, c))
    n = F.count("*")
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    rs = F.avg(F.log(H / O) * F.log(H / C) + F.log(L / O) * F.log(L / C))
    return staged.groupBy(key).agg(F.when(n > 1, F.sqrt(F.var_samp(F.log(O / F.col("_pc"))) + k * F.var_samp(F.log(C / O)) + (1 - k) * rs)).alias("vol"))


# -- tails ---------------------------------------------------------------------


def tailindex(df: DataFrame, key: str, x: str, k_frac: float = 0.1, min_k: int = 10) -> DataFrame:
    """Hill's index of the positive values by key."""
    positive = df.filter(finite(F.col(x)) > 0)
    by = Window.partitionBy(key)
    staged = positive.withColumn("_k", F.greatest(F.lit(min_k), F.ceil(k_frac * F.count("*").over(by)).cast("int"))).withColumn("_i", F.row_number().over(by.orderBy(F.desc(x))))
    return staged.groupBy(key).agg(F.when(F.max("_i") > F.max("_k"), F.avg(F.when(F.col("_i") <= F.col("_k"), F.log(x))) - F.max(F.when(F.col("_i") == F.col("_k") + 1, F.log(x)))).alias("tail"))


def cornishfishervar(r: Column, alpha: float = 0.95) -> Column:
    """Aggregate: value at risk by the expansion in skewness and excess kurtosis; null below 30 returns."""
    x = finite(r)
    n = F.count(x)
    shrink = F.sqrt((n - 1.0) / n)
    s, k = F.skewness(x) * F.pow(shrink, 3), (F.kurtosis(x) + 3.0) * F.pow(shrink, 4) - 3.0
    from statistics import NormalDist

    z = NormalDist().inv_cdf(1 - alpha)
    adjusted = z + (z * z - 1) / 6 * s + (z**3 - 3 * z) / 24 * k - (2 * z**3 - 5 * z) / 36 * s * s
    return F.when(n >= 30, -1.0 * (F.avg(x) + adjusted * F.stddev_samp(x)))


def evtvar(df: DataFrame, key: str, r: str, alpha: float = 0.99, threshold_pct: float = 0.9) -> DataFrame:
    """Peaks over threshold by key: u, xi, scale (by moments), var, es."""
    loss = df.select(key, (-1.0 * finite(F.col(r))).alias("loss")).dropna()
    staged = loss.withColumn("_u", F.percentile("loss", F.lit(threshold_pct)).over(Window.partitionBy(key)))
    over = F.when(F.col("loss") > F.col("_u"), F.col("loss") - F.col("_u"))
    row = staged.groupBy(key).agg(F.first("_u").alias("u"), F.avg(over).alias("m"), F.var_samp(over).alias("v"), F.count(over).alias("nu"), F.count("*").alias("n")).filter("n >= 250 AND nu >= 20")
    xi = 0.5 * (1.0 - F.col("m") * F.col("m") / F.col("v"))
    scale = 0.5 * F.col("m") * (F.col("m") * F.col("m") / F.col("v") + 1.0)
    staged = row.withColumn("xi", xi).withColumn("scale", scale)
    tail = F.col("nu") / F.col("n")
    var = F.when(F.abs("xi") < 1e-8, F.col("u") + F.col("scale") * F.log(tail / (1 - alpha))).otherwise(F.col("u") + F.col("scale") / F.col("xi") * (F.pow((1 - alpha) / tail, -F.col("xi")) - 1.0))
    staged = staged.withColumn("var", var)
    return staged.select(key, "u", "xi", "scale", "var", F.when(F.col("xi") < 1, (F.col("var") + F.col("scale") - F.col("xi") * F.col("u")) / (1.0 - F.col("xi"))).alias("es"))


def mes(df: DataFrame, asset: str, system: str, tau: float = 0.05) -> DataFrame:
    """Mean loss of the asset on the system's worst days: mes, n."""
    both = df.select(finite(F.col(asset)).alias("a"), finite(F.col(system)).alias("s")).dropna()
    cut = both.agg(F.percentile("s", F.lit(tau)).alias("q"))  # one row
    return both.crossJoin(F.broadcast(cut)).filter("s <= q").agg((-1.0 * F.avg("a")).alias("mes"), F.count("*").alias("n"))


# -- tests ---------------------------------------------------------------------


def mht_correction(df: DataFrame, p: str, id_col: str, method: str = "bh", by: list[str] | None = None) -> DataFrame:
    """df with p-values adjusted for the number of tests (by group): bonferroni, holm or bh."""
    group = Window.partitionBy(*(by or [F.lit(1)]))
    n, up = F.count("*").over(group), group.orderBy(p, id_col)
    staged = df.withColumn("_n", n).withColumn("_i", F.row_number().over(up))
    if method == "bonferroni":
        value = F.col(p) * F.col("_n")
    elif method == "holm":
        value = F.max(F.col(p) * (F.col("_n") - F.col("_i") + 1)).over(up.rowsBetween(Window.unboundedPreceding, 0))
    elif method == "bh":
        down = group.orderBy(F.desc("_i"))  # a frame that grows takes a pass; one that ends with the group is added up anew for each row
        value = F.min(F.col(p) * F.col("_n") / F.col("_i")).over(down.rowsBetween(Window.unboundedPreceding, 0))
    else:
        raise ValueError(f"method {method!r} is not bonferroni, holm or bh")
    return staged.withColumn("adjusted", F.least(F.lit(1.0), value)).drop("_n", "_i")


def autocorrelations(df: DataFrame, key: str, over: WindowSpec, x: str, h: int) -> DataFrame:
    """n and the autocorrelations r1 .. rh by key."""
    staged = df.withColumn("_d", F.col(x) - F.avg(x).over(Window.partitionBy(key)))
    staged = staged.select(key, "_d", *[(F.col("_d") * F.lag("_d", k).over(over)).alias(f"_p{k}") for k in range(1, h + 1)])
    return staged.groupBy(key).agg(F.count("_d").alias("n"), *[(F.sum(f"_p{k}") / F.sum(F.col("_d") * F.col("_d"))).alias(f"r{k}") for k in range(1, h + 1)])


def ljungbox(df: DataFrame, key: str, over: WindowSpec, x: str, h: int = 10, dof_correction: int = 0) -> DataFrame:
    """By key: the statistic q of h lags, n, and p_value with h - dof_correction degrees of freedom."""
    a = autocorrelations(df, key, over, x, h)
    total = sum((F.col(f"r{k}") * F.col(f"r{k}") / (F.col("n") - k) for k in range(1, h + 1)), F.lit(0.0))
    return a.select(key, (F.col("n") * (F.col("n") + 2) * total).alias("q"), "n").withColumn("p_value", chi2sf(F.col("q"), h - dof_correction))


def boxpierce(df: DataFrame, key: str, over: WindowSpec, x: str, h: int = 10, dof_correction: int = 0) -> DataFrame:
    """By key: the statistic q of h lags, n, and p_value with h - dof_correction degrees of freedom."""
    a = autocorrelations(df, key, over, x, h)
    return a.select(key, (F.col("n") * sum((F.col(f"r{k}") * F.col(f"r{k}") for k in range(1, h + 1)), F.lit(0.0))).alias("q"), "n").withColumn("p_value", chi2sf(F.col("q"), h - dof_correction))


def durbinwatson(df: DataFrame, key: str, over: WindowSpec, x: str) -> DataFrame:
    staged = df.withColumn("_s", F.col(x) - F.lag(x).over(over))
    return staged.groupBy(key).agg((F.sum(F.col("_s") * F.col("_s")) / F.sum(F.col(x) * F.col(x))).alias("dw"))


def jarquebera(x: Column) -> Column:
    """Aggregate: the statistic from population moments."""
    v = finite(x)
    return F.count(v) / 6.0 * (F.pow(F.skewness(v), 2) + F.pow(F.kurtosis(v), 2) / 4.0)


def jarquebera_p(statistic: Column) -> Column:
    """Chance of a statistic as large under normality: chi squared with two degrees of freedom."""
    return chi2sf(statistic, 2)


#: By bounds of the adjusted statistic, coefficients of the exponent of p (or of 1 - p below 0.34).
NORMALITY = ((0.2, True, (-13.436, 101.14, -223.73)), (0.34, True, (-8.318, 42.796, -59.938)), (0.6, False, (0.9177, -4.279, -1.38)), (None, False, (1.2937, -5.709, 0.0186)))


def andersondarling_p(adjusted: Column) -> Column:
    """The approximate p value of an adjusted statistic."""
    out = None
    for bound, upper, (a, b, c) in NORMALITY:
        p = F.exp(a + b * adjusted + c * adjusted * adjusted)
        p = 1.0 - p if upper else p
        out = F.when(adjusted < bound, p) if out is None else out.when(adjusted < bound, p) if bound else out.when(adjusted.isNotNull(), p)
    return out


def andersondarling(df: DataFrame, key: str, x: str) -> DataFrame:
    """The statistic A2, A2 adjusted for small samples, and its p_value, by key."""
    by = Window.partitionBy(key)
    z = (F.col(x) - F.avg(x).over(by)) / F.stddev_samp(x).over(by)
    staged = df.withColumn("_z", z).withColumn("_i", F.row_number().over(by.orderBy("_z"))).withColumn("_n", F.count("*").over(by))
    staged = staged.withColumn("_p", normcdf(F.col("_z"))).withColumn("_c", normcdf(-1.0 * F.col("_z")))
    total = F.sum((2 * F.col("_i") - 1) / F.col("_n") * F.log("_p") + (2 * (F.col("_n") - F.col("_i")) + 1) / F.col("_n") * F.log("_c"))
    out = staged.groupBy(key).agg((-1.0 * F.count("*") - total).alias("a2"), F.count("*").alias("n"))
    out = out.withColumn("adjusted", F.col("a2") * (1.0 + 0.75 / F.col("n") + 2.25 / (F.col("n") * F.col("n"))))
    return out.withColumn("p_value", andersondarling_p(F.col("adjusted")))


def spearmanrank(df: DataFrame, x: str, y: str) -> DataFrame:
    from .factors import _ranked

    both = df.select(F.lit(1).alias("g"), finite(F.col(x)).alias("x"), finite(F.col(y)).alias("y")).dropna()
    return _ranked(both, ["g"], "x", "y").agg(F.corr("rank_x", "rank_y").alias("rho"), F.count("*").alias("n"))


def chatterjeexi(df: DataFrame, x: str, y: str, tie: str) -> DataFrame:
    """Chatterjee's coefficient of y on x: ranks of y in order of x; ties of x in order of ``tie``; p_value two-sided, from its limit."""
    both = df.select(F.lit(1).alias("g"), finite(F.col(x)).alias("x"), finite(F.col(y)).alias("y"), F.col(tie).alias("tie")).dropna()
    from .factors import _ranked

    ranked = _ranked(both, ["g"], "y")
    step = F.abs(F.lead("rank_y").over(Window.partitionBy("g").orderBy("x", "tie")) - F.col("rank_y"))
    return ranked.withColumn("_s", step).agg((1.0 - 3.0 * F.sum("_s") / (F.pow(F.count("*"), 2) - 1.0)).alias("xi"), F.count("*").alias("n")).withColumn("p_value", 2.0 * normcdf(-1.0 * F.abs(F.col("xi")) * F.sqrt(2.5 * F.col("n"))))


def downsidecorr(df: DataFrame, x: str, y: str, threshold: float = 0.0) -> DataFrame:
    below = df.filter((finite(F.col(x)) < threshold) & (finite(F.col(y)) < threshold))
    return below.agg(F.when(F.count("*") >= 20, F.corr(x, y)).alias("corr"), F.count("*").alias("n"))


def varianceratio(df: DataFrame, key: str, over: WindowSpec, x: str, lags: int = 2) -> DataFrame:
    """Lo and MacKinlay's ratio of x's changes over ``lags`` rows to those over one: vr, z (homoskedastic)."""
    d1, dq = F.col(x) - F.lag(x).over(over), F.col(x) - F.lag(x, lags).over(over)
    staged = df.withColumn("_a", d1).withColumn("_b", dq)
    n = F.count("_a")
    staged = staged.withColumn("_m", F.avg("_a").over(Window.partitionBy(key)))
    m = lags * (n - lags + 1) * (1 - lags / n)
    vr = (F.sum(F.pow(F.col("_b") - lags * F.col("_m"), 2)) / m) / (F.sum(F.pow(F.col("_a") - F.col("_m"), 2)) / (n - 1))
    return staged.groupBy(key).agg(vr.alias("vr"), ((vr - 1) / F.sqrt(2 * (2 * lags - 1) * (lags - 1) / (3 * lags * n))).alias("z"))


def neweywestse(df: DataFrame, t: str, y: str, x: str, bandwidth: int) -> DataFrame:
    """y on x and a constant with Bartlett weights: alpha, beta, se_alpha, se_beta."""
    over = Window.orderBy(t)
    fit = df.agg(F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"))  # one row
    e = df.crossJoin(F.broadcast(fit)).withColumn("e", F.col(y) - F.col("_a") - F.col("_b") * F.col(x)).withColumn("v", F.col("e") * F.col(x))
    terms = [F.sum(F.lit(1.0)).alias("n"), F.sum(x).alias("sx"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.first("_a").alias("alpha"), F.first("_b").alias("beta")]
    sums = {"ee": F.col("e") * F.col("e"), "ev": F.col("e") * F.col("v"), "vv": F.col("v") * F.col("v")}
    staged = e
    for k in range(1, bandwidth + 1):
        staged = staged.withColumn(f"le{k}", F.lag("e", k).over(over)).withColumn(f"lv{k}", F.lag("v", k).over(over))
        w = 1 - k / (bandwidth + 1)
        sums["ee"] = sums["ee"] + 2 * w * F.coalesce(F.col("e") * F.col(f"le{k}"), F.lit(0.0))
        sums["ev"] = sums["ev"] + w * F.coalesce(F.col("e") * F.col(f"lv{k}") + F.col("v") * F.col(f"le{k}"), F.lit(0.0))
        sums["vv"] = sums["vv"] + 2 * w * F.coalesce(F.col("v") * F.col(f"lv{k}"), F.lit(0.0))
    row = staged.agg(*terms, *[F.sum(c).alias(k) for k, c in sums.items()])
    det = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    va = (F.col("sxx") * F.col("sxx") * F.col("ee") - 2 * F.col("sx") * F.col("sxx") * F.col("ev") + F.col("sx") * F.col("sx") * F.col("vv")) / (det * det)
    vb = (F.col("sx") * F.col("sx") * F.col("ee") - 2 * F.col("n") * F.col("sx") * F.col("ev") + F.col("n") * F.col("n") * F.col("vv")) / (det * det)
    return row.select("alpha", "beta", F.sqrt(va).alias("se_alpha"), F.sqrt(vb).alias("se_beta"))


# -- causal --------------------------------------------------------------------


def iv(df: DataFrame, y: str, x: str, z: str) -> DataFrame:
    """One instrument for one regressor: beta, alpha, first_stage_f, n."""
    beta = F.covar_samp(z, y) / F.covar_samp(z, x)
    rho = F.corr(z, x)
    f = rho * rho * (F.count("*") - 2) / (1.0 - rho * rho)
    return df.agg(beta.alias("beta"), (F.avg(y) - beta * F.avg(x)).alias("alpha"), f.alias("first_stage_f"), F.count("*").alias("n"))


def rdd(df: DataFrame, x: str, y: str, cutoff: float, bandwidth: float | None = None) -> DataFrame:
    """Sharp discontinuity: lines by triangular weights on both sides of the cutoff; effect, left, right, bandwidth."""
    if bandwidth is None:
        row = df.agg((1.5 * F.stddev_samp(x) * F.pow(F.count("*"), F.lit(-0.2))).alias("_h"))  # one row
        staged = df.crossJoin(F.broadcast(row))
    else:
        staged = df.withColumn("_h", F.lit(float(bandwidth)))
    staged = staged.withColumn("_c", F.col(x) - cutoff).withColumn("_w", 1.0 - F.abs("_c") / F.col("_h")).filter("_w > 0")
    w, c, v = F.col("_w"), F.col("_c"), F.col(y)
    sums = staged.groupBy((F.col("_c") >= 0).alias("right")).agg(F.sum(w).alias("w"), F.sum(w * c).alias("wx"), F.sum(w * c * c).alias("wxx"), F.sum(w * v).alias("wy"), F.sum(w * c * v).alias("wxy"), F.first("_h").alias("h"))
    level = (F.col("wxx") * F.col("wy") - F.col("wx") * F.col("wxy")) / (F.col("w") * F.col("wxx") - F.col("wx") * F.col("wx"))
    sides = sums.select("right", level.alias("level"), "h")
    pick = lambda side: F.max(F.when(F.col("right") == side, F.col("level")))
    return sides.agg((pick(True) - pick(False)).alias("effect"), pick(False).alias("left"), pick(True).alias("right_level"), F.max("h").alias("bandwidth"))
