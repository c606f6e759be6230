"""Queries of alignment, bars, pivots, merges, corporate actions and missing values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import panels as P
from .catalogue import register
from .views import Views, by_series, with_views

STATUSES = ("F", "O", "P")


def _series(v: Views):
    """One series by status, of days whose number doesn't divide by 3 + its place (so that indexes differ)."""
    px = v.px
    return [px.filter((F.col("s") == s) & (F.dayofyear("d") % (3 + k) != 0)).select(F.col("d").alias("t"), "x") for k, s in enumerate(STATUSES)]


_PARTS = ", ".join(f"s{k} AS (SELECT d AS t, x FROM px WHERE s = '{s}' AND dayofyear(d) % {3 + k} <> 0)" for k, s in enumerate(STATUSES))
for _method, _join in (("inner", "JOIN"), ("outer", "FULL JOIN")):
    register(f"align_{_method}", lambda v, m=_method: P.align(_series(v), method=m), with_views("SELECT t, round(s0.x, 6) AS x0, round(s1.x, 6) AS x1, round(s2.x, 6) AS x2 " + f"FROM s0 {_join} s1 USING (t) {_join} s2 USING (t)", "px").replace(" SELECT t, round", f", {_PARTS} SELECT t, round", 1))
register("align_forward", lambda v: P.align(_series(v), method="forward"), with_views("SELECT t, " + ", ".join(f"round(last_value(s{k}.x IGNORE NULLS) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING), 6) AS x{k}" for k in range(3)) + " FROM s0 FULL JOIN s1 USING (t) FULL JOIN s2 USING (t)", "px").replace(" SELECT t, round", f", {_PARTS} SELECT t, round", 1))

register("baragg", lambda v: P.baragg(v.ticks.withColumn("d", F.to_date("ts")), ["symbol", "d"], "seq", "px", volume="px"), with_views("SELECT symbol, CAST(ts AS DATE) AS d, round(arg_min(px, seq), 6) AS open, round(max(px), 6) AS high, round(min(px), 6) AS low, round(arg_max(px, seq), 6) AS close, round(sum(px), 6) AS volume, count(*) AS n_input FROM ticks GROUP BY 1, 2", "ticks"))
for _method, _sql in (("last", "arg_max(px, seq)"), ("first", "arg_min(px, seq)"), ("mean", "avg(px)"), ("sum", "coalesce(sum(px), 0)")):
    register(f"resample_{_method}", lambda v, m=_method: P.resample(v.ticks.withColumn("b", F.floor(F.unix_timestamp("ts") / 3600)), ["symbol", "b"], "seq", "px", m), with_views(f"SELECT symbol, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS b, round({_sql}, 6) AS value, count(*) AS n_input FROM ticks GROUP BY 1, 2", "ticks"))
register("panelize", lambda v: P.panelize(v.px, "d", "s", "x", list(STATUSES)), with_views("SELECT d, " + ", ".join(f"round(max(CASE WHEN s = '{s}' THEN x END), 6) AS {s}" for s in STATUSES) + " FROM px GROUP BY d", "px"))
register("unpanelize", lambda v: P.unpanelize(P.panelize(v.holes, "d", "s", "x", list(STATUSES)), "d"), with_views("SELECT d, s AS name, round(x, 6) AS value FROM holes WHERE x IS NOT NULL", "holes"))
for _method, _pick in (("first_wins", "arg_min"), ("last_wins", "arg_max")):
    register(f"stitch_{_method}", lambda v, m=_method: P.stitch([v.holes.select("s", "d", "x"), v.holes.filter("month(d) < 7").select("s", "d", (F.col("y") / 2).alias("x"))], ["s", "d"], "x", m), with_views(f"SELECT s, d, round({_pick}(x, k) FILTER (x IS NOT NULL), 6) AS x, count(x) AS n_panels, coalesce(max(x) - min(x) > 1e-9, false) AS conflict FROM (SELECT s, d, x, 0 AS k FROM holes UNION ALL SELECT s, d, y / 2, 1 FROM holes WHERE month(d) < 7) GROUP BY s, d", "holes"))


def _events(v: Views):
    day = F.dayofyear("d")
    return v.px.withColumn("split", F.when(day == 100, 2.0).when(day == 200, 4.0)).withColumn("dividend", F.when(day % 60 == 0, 500.0))


_STEP = "e AS (SELECT *, CASE dayofyear(d) WHEN 100 THEN 0.5 WHEN 200 THEN 0.25 ELSE 1 END::DOUBLE * CASE WHEN dayofyear(d) % 60 = 0 AND lag(x) OVER (PARTITION BY s ORDER BY d) > 500 THEN (lag(x) OVER (PARTITION BY s ORDER BY d) - 500) / lag(x) OVER (PARTITION BY s ORDER BY d) ELSE 1 END AS f FROM px)"
for _direction, _factor in (("backward", "coalesce(product(f) OVER (PARTITION BY s ORDER BY d ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1)"), ("forward", "product(1 / f) OVER (PARTITION BY s ORDER BY d ROWS UNBOUNDED PRECEDING)")):
    # Splits of many years multiply, so factors are compared by their logarithms.
    register(
        f"corpaction_{_direction}",
        lambda v, k=_direction: P.corpaction(_events(v), by_series(), "x", "split", "dividend", k).select("s", "d", F.ln("factor").alias("log_factor"), F.ln("adjusted").alias("log_adjusted")),
        with_views(f"SELECT s, d, round(ln(factor), 8) + 0.0::DOUBLE AS log_factor, round(ln(x * factor), 8) + 0.0::DOUBLE AS log_adjusted FROM (SELECT *, {_factor} AS factor FROM e)", "px").replace(" SELECT s, d, round", f", {_STEP} SELECT s, d, round", 1),
        8,
    )

register("skipna", lambda v: P.skipna(v.holes, "x", "y"), with_views("SELECT s, d, round(x, 6) AS x, round(y, 6) AS y FROM holes WHERE x IS NOT NULL AND y IS NOT NULL", "holes"))
register("strict_policy", lambda v: P.strict(v.px, "x"), with_views("SELECT s, d, round(x, 6) AS x FROM px", "px"))
register("forwardfill", lambda v: v.holes.select("s", "d", P.forwardfill(F.col("x"), by_series()).alias("v")), with_views("SELECT s, d, round(last_value(x IGNORE NULLS) OVER (PARTITION BY s ORDER BY d ROWS UNBOUNDED PRECEDING), 6) AS v FROM holes", "holes"))
register("interpolate", lambda v: P.interpolated(v.holes, "x", by_series(), "v").select("s", "d", "v"), with_views("SELECT s, d, round(coalesce(x, lo.x + (i - lo.i) * (hi.x - lo.x) / (hi.i - lo.i)), 6) AS v FROM (SELECT *, last_value(p IGNORE NULLS) OVER (PARTITION BY s ORDER BY d ROWS UNBOUNDED PRECEDING) AS lo, first_value(p IGNORE NULLS) OVER (PARTITION BY s ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi FROM (SELECT *, CASE WHEN x IS NOT NULL THEN {'i': i, 'x': x} END AS p FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY d) AS i FROM holes)))", "holes"))
register("dropcolumn", lambda v: P.dropcolumn(v.panel.select("name", "t", F.col("fwd").alias("x")), "name", "x", 0.95).groupBy("name").agg(F.count("*").alias("n")), with_views("SELECT name, count(*) AS n FROM panel GROUP BY name HAVING avg(CASE WHEN isfinite(fwd) THEN 1.0 ELSE 0.0 END) >= 0.95", "panel"))
_OUT = {
    "mad": ("abs(x - quantile_cont(x, 0.5) OVER w) AS a, x", "a > 3 * 1.4826::DOUBLE * quantile_cont(a, 0.5) OVER (PARTITION BY s)"),
    "iqr": ("quantile_cont(x, 0.25) OVER w AS q1, quantile_cont(x, 0.75) OVER w AS q3, x", "x < q1 - 1.5::DOUBLE * (q3 - q1) OR x > q3 + 1.5::DOUBLE * (q3 - q1)"),
    "zscore": ("avg(x) OVER w AS m, stddev_samp(x) OVER w AS sd, x", "abs(x - m) / sd > 3"),
}
for _method, (_inner, _flag) in _OUT.items():
    register(f"outlierpolicy_{_method}", lambda v, m=_method: P.outlierpolicy(v.holes, ["s"], "x", m).select("s", "d", "outlier"), with_views(f"SELECT s, d, coalesce({_flag}, false) AS outlier FROM (SELECT s, d, {_inner} FROM holes WINDOW w AS (PARTITION BY s))", "holes"))
_AT = "(SELECT *, row_number() OVER (PARTITION BY s ORDER BY d) - 1 AS i FROM px)"


def _placed(v: Views):
    return v.px.withColumn("i", F.row_number().over(by_series()) - 1)


register("zero_after_delist", lambda v: _placed(v).select("s", "d", P.zero_after_delist(F.col("x"), F.col("i"), F.lit(1000)).alias("v")), with_views(f"SELECT s, d, round(CASE WHEN i >= 1000 THEN 0 ELSE x END, 6) AS v FROM {_AT}", "px"))
register("hold_last_price", lambda v: _placed(v).select("s", "d", P.hold_last_price(F.col("x"), F.col("i"), F.lit(1000), by_series()).alias("v")), with_views(f"SELECT s, d, round(CASE WHEN i >= 1000 THEN max(CASE WHEN i = 999 THEN x END) OVER (PARTITION BY s) ELSE x END, 6) AS v FROM {_AT}", "px"))
register("full_recovery_check", lambda v: P.full_recovery_check(v.table("orders").select(F.col("o_custkey").alias("k")), v.table("customer").filter("c_custkey % 7 = 0").select(F.col("c_custkey").alias("k")), "k"), "SELECT count(*) AS n_known, count(o) AS n_found, count(*) - count(o) AS n_missing, round(count(o) / count(*), 6) AS coverage, CASE WHEN count(o) / count(*) >= 0.9 THEN 'clean' ELSE 'biased' END AS status FROM (SELECT c_custkey, (SELECT max(1) FROM orders WHERE o_custkey = c_custkey) AS o FROM customer WHERE c_custkey % 7 = 0)")
