"""Alignment, bars, pivots, merges and corporate actions of long tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .rolling import finite


def align(series: list[DataFrame], index: str = "t", value: str = "x", method: str = "inner") -> DataFrame:
    """Joins series (index, value) into index, x0, x1, ...

    inner: common indexes; outer: all; forward: all, each series carried forward
    over the union (nulls before its first value stay).
    """
    if method not in ("inner", "outer", "forward"):
        raise ValueError(f"method {method!r} is not inner, outer or forward")
    if len(series) < 2:
        raise ValueError("align takes two series or more")
    named = [s.select(F.col(index), F.col(value).alias(f"x{k}")) for k, s in enumerate(series)]
    joined = reduce(lambda a, b: a.join(b, index, "inner" if method == "inner" else "full"), named)
    if method != "forward":
        return joined
    so_far = Window.orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(index, *[F.last(finite(F.col(f"x{k}")), ignorenulls=True).over(so_far).alias(f"x{k}") for k in range(len(series))])


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once: the check behind operators that ask for unique keys."""
    return df.groupBy(*keys).count().filter("count > 1")


def baragg(df: DataFrame, by: list[str], seq: str, close: str, open_: str | None = None, high: str | None = None, low: str | None = None, volume: str | None = None) -> DataFrame:
    """Bars by key: open and close are the first and last rows in order of seq (null if they are), high and low skip nulls, volume sums."""
    first, last = F.col(open_ or close), F.col(close)
    aggs = [
        F.min_by(F.struct(first.alias("v")), seq)["v"].alias("open"),
        F.max(finite(F.col(high or close))).alias("high"),
        F.min(finite(F.col(low or close))).alias("low"),
        F.max_by(F.struct(last.alias("v")), seq)["v"].alias("close"),
    ]
    if volume:
        aggs.append(F.coalesce(F.sum(finite(F.col(volume))), F.lit(0.0)).alias("volume"))
    return df.groupBy(*by).agg(*aggs, F.count("*").alias("n_input"))


def resample(df: DataFrame, by: list[str], seq: str, value: str, method: str = "last") -> DataFrame:
    """One value by key: the last or first row in order of seq, or the mean or sum of finite values (an empty sum is 0)."""
    x = F.col(value)
    how = {
        "last": lambda: F.max_by(F.struct(x.alias("v")), seq)["v"],
        "first": lambda: F.min_by(F.struct(x.alias("v")), seq)["v"],
        "mean": lambda: F.avg(finite(x)),
        "sum": lambda: F.coalesce(F.sum(finite(x)), F.lit(0.0)),
    }
    if method not in how:
        raise ValueError(f"method {method!r} is not one of {', '.join(how)}")
    return df.groupBy(*by).agg(how[method]().alias("value"), F.count("*").alias("n_input"))


def panelize(df: DataFrame, index: str, name: str, value: str, names: list | None = None) -> DataFrame:
    """Long to wide: a row by index, a column by name, null where a cell is missing; use duplicates() to check keys."""
    return df.groupBy(index).pivot(name, names).agg(F.first(value))


def unpanelize(df: DataFrame, index: str, name: str = "name", value: str = "value") -> DataFrame:
    """Wide to long, without cells that aren't finite."""
    others = [c for c in df.columns if c != index]
    return df.unpivot(index, others, name, value).filter(finite(F.col(value)).isNotNull())


def stitch(panels: list[DataFrame], keys: list[str], value: str, method: str = "first_wins") -> DataFrame:
    """Merges panels by priority: keys, value, n_panels and conflict (finite values more than 1e-9 apart)."""
    if method not in ("first_wins", "last_wins"):
        raise ValueError(f"method {method!r} is not first_wins or last_wins")
    every = reduce(DataFrame.unionByName, [p.select(*keys, F.col(value), F.lit(k).alias("_panel")) for k, p in enumerate(panels)])
    pick = F.min_by if method == "first_wins" else F.max_by
    x = finite(F.col(value))
    rank = F.when(x.isNotNull(), F.col("_panel"))
    return every.groupBy(*keys).agg(pick(x, rank).alias(value), F.count(x).alias("n_panels"), F.coalesce(F.max(x) - F.min(x) > 1e-9, F.lit(False)).alias("conflict"))


def corpaction(df: DataFrame, over: WindowSpec, price: str, split: str | None = None, dividend: str | None = None, direction: str = "backward") -> DataFrame:
    """df with factor and adjusted price for splits (ratio on the day of effect) and dividends (amount on the ex day).

    backward: rows before an event are divided by the ratio and scaled by
    (close - amount) / close of the row before the event; forward: rows from the
    event on are multiplied by the inverse.  A dividend of the whole close or
    more is left out.
    """
    before = F.lag(price).over(over)
    step: Column = F.lit(1.0)
    if split:
        step = step * F.coalesce(1.0 / F.nullif(F.col(split), F.lit(0.0)), F.lit(1.0))
    if dividend:
        step = step * F.when((F.col(dividend) > 0) & (before > F.col(dividend)), (before - F.col(dividend)) / before).otherwise(1.0)
    staged = df.withColumn("_step", step)
    if direction == "backward":
        factor = F.coalesce(F.product("_step").over(over.rowsBetween(1, Window.unboundedFollowing)), F.lit(1.0))
    elif direction == "forward":
        factor = F.product(1.0 / F.col("_step")).over(over.rowsBetween(Window.unboundedPreceding, 0))
    else:
        raise ValueError(f"direction {direction!r} is not backward or forward")
    return staged.withColumn("factor", factor).withColumn("adjusted", F.col(price) * F.col("factor")).drop("_step")


# -- missing values and outliers ----------------------------------------------


def skipna(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose columns are all finite."""
    return df.filter(reduce(lambda a, b: a & b, [finite(F.col(c)).isNotNull() for c in columns]))


def strict(df: DataFrame, *columns: str) -> DataFrame:
    """df; running it fails at the first row with a value that isn't finite."""
    bad = reduce(lambda a, b: a | b, [finite(F.col(c)).isNull() for c in columns])
    return df.filter(F.when(bad, F.raise_error(F.lit(f"not finite: {', '.join(columns)}")).cast("boolean")).otherwise(True))


def forwardfill(x: Column, over: WindowSpec) -> Column:
    return F.last(finite(x), ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, 0))


def interpolated(df: DataFrame, x: str, over: WindowSpec, out: str) -> DataFrame:
    """df with x interpolated linearly by row number between finite values; nulls beyond the ends stay."""
    behind, ahead = over.rowsBetween(Window.unboundedPreceding, 0), over.rowsBetween(0, Window.unboundedFollowing)
    staged = df.withColumn("_at", F.row_number().over(over)).withColumn("_x", finite(F.col(x)))
    point = F.when(F.col("_x").isNotNull(), F.struct(F.col("_at").alias("at"), F.col("_x").alias("x")))
    staged = staged.withColumn("_lo", F.last(point, ignorenulls=True).over(behind)).withColumn("_hi", F.first(point, ignorenulls=True).over(ahead))
    share = F.try_divide(F.col("_at") - F.col("_lo.at"), F.col("_hi.at") - F.col("_lo.at"))
    value = F.coalesce(F.col("_x"), F.col("_lo.x") + share * (F.col("_hi.x") - F.col("_lo.x")))
    return staged.withColumn(out, value).drop("_at", "_x", "_lo", "_hi")


def dropcolumn(df: DataFrame, name: str, value: str, min_finite_frac: float = 0.5) -> DataFrame:
    """Rows of names of which at least this share of values is finite."""
    kept = df.groupBy(name).agg(F.avg(finite(F.col(value)).isNotNull().cast("double")).alias("_share")).filter(F.col("_share") >= min_finite_frac)
    return df.join(kept.select(name), name, "left_semi")


def outlierpolicy(df: DataFrame, by: list[str], x: str, method: str = "mad", threshold: float | None = None, out: str = "outlier") -> DataFrame:
    """df with a flag for outliers of each group; no spread or no finite value: no flag."""
    limit = {"mad": 3.0, "iqr": 1.5, "zscore": 3.0}
    if method not in limit:
        raise ValueError(f"method {method!r} is not one of {', '.join(limit)}")
    limit = threshold if threshold is not None else limit[method]
    group = Window.partitionBy(*by)
    v = finite(F.col(x))
    if method == "mad":
        staged = df.withColumn("_m", F.percentile(v, F.lit(0.5)).over(group))
        staged = staged.withColumn("_s", 1.4826 * F.percentile(F.abs(v - F.col("_m")), F.lit(0.5)).over(group))
        flag = F.try_divide(F.abs(v - F.col("_m")), F.nullif(F.col("_s"), F.lit(0.0))) > limit
    elif method == "zscore":
        staged = df.withColumn("_m", F.avg(v).over(group)).withColumn("_s", F.stddev_samp(v).over(group))
        flag = F.try_divide(F.abs(v - F.col("_m")), F.nullif(F.col("_s"), F.lit(0.0))) > limit
    else:
        staged = df.withColumn("_m", F.percentile(v, F.lit(0.25)).over(group)).withColumn("_s", F.percentile(v, F.lit(0.75)).over(group))
        width = F.col("_s") - F.col("_m")
        flag = (width > 0) & ((v < F.col("_m") - limit * width) | (v > F.col("_s") + limit * width))
    return staged.withColumn(out, F.coalesce(flag, F.lit(False))).drop("_m", "_s")


def zero_after_delist(x: Column, at: Column, delisted: Column) -> Column:
    return F.when(at >= delisted, 0.0).otherwise(x)


def hold_last_price(x: Column, at: Column, delisted: Column, over: WindowSpec) -> Column:
    """The price of the row before the delisting from there on."""
    held = F.max(F.when(at == F.greatest(delisted - 1, F.lit(0)), x)).over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.when(at >= delisted, held).otherwise(x)


def full_recovery_check(universe: DataFrame, known: DataFrame, key: str, tolerance: float = 0.9) -> DataFrame:
    """How many known keys the universe holds: n_known, n_found, n_missing, coverage, status."""
    both = known.select(key).distinct().join(universe.select(key).distinct().withColumn("_in", F.lit(1)), key, "left")
    row = both.agg(F.count("*").alias("n_known"), F.count("_in").alias("n_found"))
    coverage = F.coalesce(F.try_divide(F.col("n_found"), F.col("n_known")), F.lit(1.0))
    return row.select("n_known", "n_found", (F.col("n_known") - F.col("n_found")).alias("n_missing"), coverage.alias("coverage"), F.when(coverage >= tolerance, "clean").otherwise("biased").alias("status"))


#: Policies by name, for callers that choose one by configuration.
POLICIES = {"strict": strict, "skipna": skipna, "forwardfill": forwardfill, "interpolate": interpolated, "dropcolumn": dropcolumn}


def available() -> tuple[str, ...]:
    return tuple(sorted(POLICIES))


def get(name: str):
    if name not in POLICIES:
        raise KeyError(f"{name!r} is not one of {', '.join(available())}")
    return POLICIES[name]
