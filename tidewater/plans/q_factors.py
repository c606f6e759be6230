"""Queries of factor evaluation, performance, tails and tests."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import functions as F

from ..functions.normal import sql_chi2sf, sql_normcdf
from ..operators import factors as A
from ..operators import performance as M
from .catalogue import register
from .views import Views, by_series, with_views


def _after(sql: str, *ctes: str) -> str:
    """Common table expressions put between the views and the last SELECT, marked by ##."""
    head, body = sql.split("##")
    return head.rstrip() + ", " + ", ".join(ctes) + " " + body


# -- cross sections ------------------------------------------------------------
_CLEAN = "cl AS (SELECT t, name, f, fwd AS r FROM panel WHERE isfinite(f) AND isfinite(fwd))"
_RK = "rk AS (SELECT t, name, rank() OVER (PARTITION BY t ORDER BY f) + (count(*) OVER (PARTITION BY t, f) - 1) / 2 AS f, rank() OVER (PARTITION BY t ORDER BY r) + (count(*) OVER (PARTITION BY t, r) - 1) / 2 AS r FROM cl)"
register("factor_ic_spearman", lambda v: A.factor_ic(v.panel, "t", "f", "fwd"), _after(with_views("##SELECT t, round(corr(f, r), 6) AS ic, count(*) AS n FROM rk GROUP BY t HAVING count(*) >= 3", "panel"), _CLEAN, _RK))
register("factor_ic_pearson", lambda v: A.factor_ic(v.panel, "t", "f", "fwd", "pearson"), _after(with_views("##SELECT t, round(corr(f, r), 6) AS ic, count(*) AS n FROM cl GROUP BY t HAVING count(*) >= 3", "panel"), _CLEAN))
register("factor_ic_kendall", lambda v: A.factor_ic(v.panel, "t", "f", "fwd", "kendall"), _after(with_views("##SELECT t, round(s / sqrt(p * q), 6) AS ic, n FROM (SELECT x.t, sum(sign(x.f - y.f) * sign(x.r - y.r)) AS s, sum(abs(sign(x.f - y.f))) AS p, sum(abs(sign(x.r - y.r))) AS q, count(DISTINCT x.name) AS n FROM cl x JOIN cl y ON x.t = y.t AND x.name <> y.name GROUP BY x.t) WHERE n >= 3", "panel"), _CLEAN))
register("factor_ic_summary", lambda v: A.ic_summary(A.factor_ic(v.panel, "t", "f", "fwd")), _after(with_views("##SELECT round(m, 6) AS mean, round(s, 6) AS std, round(m / s * sqrt(n), 6) AS t_stat, round(m / s * sqrt(n), 6) AS ir, round(m / s, 6) AS ir_raw, n AS n_periods FROM (SELECT avg(ic) AS m, stddev_samp(ic) AS s, count(ic) AS n FROM (SELECT corr(f, r) AS ic FROM rk GROUP BY t HAVING count(*) >= 3))", "panel"), _CLEAN, _RK))
_DAYS = "dy AS (SELECT t, row_number() OVER (ORDER BY t) AS i FROM (SELECT DISTINCT t FROM panel))"
register("factor_rank_autocorr", lambda v: A.factor_rank_autocorr(v.panel, "t", "name", "f"), _after(with_views("##SELECT t, round(corr(f, g), 6) AS autocorr, count(*) AS n FROM (SELECT t, rank() OVER (PARTITION BY t ORDER BY f) + (count(*) OVER (PARTITION BY t, f) - 1) / 2 AS f, rank() OVER (PARTITION BY t ORDER BY g) + (count(*) OVER (PARTITION BY t, g) - 1) / 2 AS g FROM pr) GROUP BY t HAVING count(*) >= 3", "panel"), _DAYS, "pr AS (SELECT a.t, a.name, a.f, b.f AS g FROM panel a JOIN dy x ON a.t = x.t JOIN dy z ON z.i = x.i - 1 JOIN panel b ON b.t = z.t AND b.name = a.name)"))
_BIN = "bn AS (SELECT t, name, fwd, CASE WHEN n >= 5 THEN len(list_filter(e, lambda q: f >= q)) END AS bin FROM (SELECT *, quantile_cont(f, [0.2, 0.4, 0.6, 0.8]) OVER (PARTITION BY t) AS e, count(f) OVER (PARTITION BY t) AS n FROM panel))"
_MEAN = "mr AS (SELECT t, bin, avg(CASE WHEN isfinite(fwd) THEN fwd END) AS mean_return, count(*) AS n FROM bn WHERE bin IS NOT NULL GROUP BY t, bin)"
register("mean_return_by_quantile", lambda v: A.mean_return_by_quantile(v.panel, "t", "f", "fwd").withColumn("bin", F.col("bin").cast("long")), _after(with_views("##SELECT t, bin, round(mean_return, 6) AS mean_return, n FROM mr", "panel"), _BIN, _MEAN))
register("quantile_spread", lambda v: A.quantile_spread(v.panel, "t", "f", "fwd"), _after(with_views("##SELECT t, round(max(CASE WHEN bin = 4 THEN mean_return END) - max(CASE WHEN bin = 0 THEN mean_return END), 6) AS spread FROM mr GROUP BY t", "panel"), _BIN, _MEAN))
register("quantile_turnover", lambda v: A.quantile_turnover(v.panel, "t", "name", "f"), _after(with_views("##SELECT z.t, round(avg(CASE WHEN a.bin = 4 THEN CASE WHEN b.bin = 4 THEN 0.0 ELSE 1.0 END END), 6) AS top, round(avg(CASE WHEN a.bin = 0 THEN CASE WHEN b.bin = 0 THEN 0.0 ELSE 1.0 END END), 6) AS bottom FROM bn a JOIN dy x ON x.t = a.t JOIN dy z ON z.i = x.i + 1 LEFT JOIN bn b ON b.t = z.t AND b.name = a.name AND b.bin IN (0, 4) WHERE a.bin IN (0, 4) GROUP BY z.t", "panel"), _BIN, _DAYS))
register("winsorize", lambda v: A.winsorize(v.panel, ["t"], "f", 0.05, 0.95).select("t", "name", "clipped"), with_views("SELECT t, name, round(greatest(quantile_cont(f, 0.05) OVER (PARTITION BY t), least(quantile_cont(f, 0.95) OVER (PARTITION BY t), f)), 8) AS clipped FROM panel", "panel"), 8)
register("neutralize", lambda v: A.neutralize(v.panel, ["t"], "fwd", "f").select("t", "name", "residual"), _after(with_views("##SELECT p.t, p.name, round(CASE WHEN isfinite(p.fwd) THEN p.fwd - a - b * p.f END, 5) + 0.0::DOUBLE AS residual FROM panel p JOIN rg USING (t)", "panel"), _CLEAN, "rg AS (SELECT t.t, regr_intercept(r, f) AS a, regr_slope(r, f) AS b FROM (SELECT DISTINCT t FROM panel) t LEFT JOIN cl USING (t) GROUP BY t.t)"), 5)
register("neutralize_many", lambda v: A.neutralize_many(v.holes.withColumn("k", F.dayofyear("d").cast("double")), "y", ["k"]).select("s", "d", "residual"), with_views("SELECT s, d, round(y - (SELECT regr_intercept(y, dayofyear(d)) FROM holes) - (SELECT regr_slope(y, dayofyear(d)) FROM holes) * dayofyear(d), 3) AS residual FROM holes", "holes"), 3)
_IC = "ah AS (SELECT s, d, x AS f, " + ", ".join(f"CASE WHEN count(r) OVER (PARTITION BY s ORDER BY d ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) = {h} THEN sum(r) OVER (PARTITION BY s ORDER BY d ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) END AS h{h}" for h in (1, 5, 21)) + " FROM (SELECT s, d, x, x / lag(x) OVER (PARTITION BY s ORDER BY d) - 1 AS r FROM px))"
_LONG = "lg AS (" + " UNION ALL ".join(f"SELECT s, {h} AS horizon, f, h{h} AS r FROM ah WHERE h{h} IS NOT NULL" for h in (1, 5, 21)) + ")"
register("icdecay", lambda v: A.icdecay(v.px.withColumn("r", F.col("x") / F.lag("x").over(by_series()) - 1), "s", "d", "x", "r", (1, 5, 21)), _after(with_views("##SELECT s, horizon, round(corr(f, r), 6) AS ic, round(1 / sqrt(count(*)), 6) AS ic_stderr, round(corr(f, r) * sqrt(count(*)), 6) AS ic_tstat, count(*) AS n FROM (SELECT s, horizon, rank() OVER (PARTITION BY s, horizon ORDER BY f) + (count(*) OVER (PARTITION BY s, horizon, f) - 1) / 2 AS f, rank() OVER (PARTITION BY s, horizon ORDER BY r) + (count(*) OVER (PARTITION BY s, horizon, r) - 1) / 2 AS r FROM lg) GROUP BY 1, 2", "px"), _IC, _LONG))
register("dispersioncollapse", lambda v: A.dispersioncollapse(v.panel, "t", "f", 10, 0.4, 2), with_views("SELECT t, round(dispersion, 6) AS dispersion, sum(low) OVER (ORDER BY t ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) = 2 AS collapsed FROM (SELECT *, coalesce(dispersion < CASE WHEN count(*) OVER w = 10 THEN quantile_cont(dispersion, 0.4) OVER w END, false)::INT AS low FROM (SELECT t, stddev_samp(f) AS dispersion FROM panel GROUP BY t) WINDOW w AS (ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))", "panel"))

# -- aggregates of returns -----------------------------------------------------
_R = "r"


def _agg(name: str, column, sql: str, digits: int = 6) -> None:
    register(name, lambda v: v.ret.groupBy("s").agg(column().alias("v")), with_views(f"SELECT s, round({sql}, {digits}) + 0.0::DOUBLE AS v FROM ret GROUP BY s", "ret"), digits)


_agg("sharperatio", lambda: M.sharperatio(F.col("r")), "avg(r) * sqrt(252) / stddev_samp(r)")
_agg("sortinoratio", lambda: M.sortinoratio(F.col("r")), "avg(r) * sqrt(252) / sqrt(avg(least(r, 0) * least(r, 0)))")
_agg("omega", lambda: M.omega(F.col("r"), 0.01), "sum(greatest(r - 0.01, 0)) / sum(greatest(0.01 - r, 0))")
_agg("kelly", lambda: M.kelly(F.col("r")), "greatest(0, least(1, avg(r) / var_samp(r)))")
register("jarquebera", lambda v: v.ret.groupBy("s").agg(M.jarquebera(F.col("r")).alias("v")).withColumn("p_value", M.jarquebera_p(F.col("v"))), with_views("SELECT s, round(v, 3) AS v, round(exp(-v / 2), 3) AS p_value FROM (SELECT s, n / 6 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4) AS v FROM (SELECT s, count(*) AS n, avg(pow(r - m, 2)) AS m2, avg(pow(r - m, 3)) AS m3, avg(pow(r - m, 4)) AS m4 FROM (SELECT *, avg(r) OVER (PARTITION BY s) AS m FROM ret) GROUP BY s))", "ret"), 3)
_Z = NormalDist().inv_cdf(0.05)
register("cornishfishervar", lambda v: v.ret.groupBy("s").agg(M.cornishfishervar(F.col("r")).alias("v")), with_views(f"SELECT s, round(-(m + ({_Z!r}::DOUBLE + {(_Z * _Z - 1) / 6!r}::DOUBLE * k3 + {(_Z**3 - 3 * _Z) / 24!r}::DOUBLE * (k4 - 3) - {(2 * _Z**3 - 5 * _Z) / 36!r}::DOUBLE * k3 * k3) * sd), 6) AS v FROM (SELECT s, any_value(m) AS m, any_value(sd) AS sd, avg(pow((r - m) / sd, 3)) AS k3, avg(pow((r - m) / sd, 4)) AS k4 FROM (SELECT *, avg(r) OVER (PARTITION BY s) AS m, stddev_samp(r) OVER (PARTITION BY s) AS sd FROM ret) GROUP BY s)", "ret"))
register("up_down_capture", lambda v: v.both.agg(M.up_capture(F.col("a"), F.col("b")).alias("up"), M.down_capture(F.col("a"), F.col("b")).alias("down")), with_views("SELECT round(avg(a) FILTER (b > 0) / avg(b) FILTER (b > 0), 6) AS up, round(avg(a) FILTER (b < 0) / avg(b) FILTER (b < 0), 6) AS down FROM both_", "both"))
_MOMENTS = "mo AS (SELECT s, n, m / sd AS sr, k3, k4 FROM (SELECT s, count(*)::DOUBLE AS n, any_value(m) AS m, any_value(sd) AS sd, avg(pow(r - m, 3)) / pow(avg(pow(r - m, 2)), 1.5) AS k3, avg(pow(r - m, 4)) / pow(avg(pow(r - m, 2)), 2) AS k4 FROM (SELECT *, avg(r) OVER (PARTITION BY s) AS m, stddev_samp(r) OVER (PARTITION BY s) AS sd FROM ret) GROUP BY s))"


def _moments(v: Views):
    return v.ret.groupBy("s").agg((F.avg("r") / F.stddev_samp("r")).alias("sr"), F.count("*").cast("double").alias("n"), F.skewness("r").alias("k3"), (F.kurtosis("r") + 3).alias("k4"))


_DEN = "sqrt(1 - k3 * sr + (k4 - 1) / 4 * sr * sr)"
register("probabilistic_sharpe", lambda v: _moments(v).select("s", M.probabilistic_sharpe(F.col("sr"), F.col("n"), F.col("k3"), F.col("k4"), 0.05).alias("v")), _after(with_views(f"##SELECT s, round({sql_normcdf('q')}, 6) AS v FROM (SELECT s, (sr - 0.05::DOUBLE) * sqrt(n - 1) / {_DEN} AS q FROM mo)", "ret"), _MOMENTS))
_E = 0.5772156649015329
_MAX = (1 - _E) * NormalDist().inv_cdf(1 - 1 / 10) + _E * NormalDist().inv_cdf(1 - 1 / (10 * math.e))
register("deflated_sharpe", lambda v: _moments(v).select("s", M.deflated_sharpe(F.col("sr"), F.col("n"), 10, F.lit(0.0004), F.col("k3"), F.col("k4")).alias("v")), _after(with_views(f"##SELECT s, round({sql_normcdf('q')}, 5) AS v FROM (SELECT s, (sr - 0.02::DOUBLE * {_MAX!r}::DOUBLE) * sqrt(n - 1) / {_DEN} AS q FROM mo)", "ret"), _MOMENTS), 5)

# -- drawdowns -----------------------------------------------------------------
_DD = "dd AS (SELECT s, d, x, max(x) OVER w AS peak, x / max(x) OVER w - 1 AS dd FROM px WINDOW w AS (PARTITION BY s ORDER BY d ROWS UNBOUNDED PRECEDING))"
register("drawdown_series", lambda v: M.drawdowns(v.px, by_series(), "x").select("s", "d", "peak", "drawdown"), _after(with_views("##SELECT s, d, round(peak, 6) AS peak, round(dd, 6) + 0.0::DOUBLE AS drawdown FROM dd", "px"), _DD))
register("drawdown", lambda v: M.drawdown(v.px, "s", "d", "x"), _after(with_views("##SELECT t.s, round(t.dd, 6) AS max_dd, min(CASE WHEN p.x = t.peak AND p.d <= t.d THEN p.d END) AS peak_t, t.d AS trough_t, coalesce(max(p.d > t.d AND p.x >= t.peak), false) AS recovered FROM (SELECT * FROM dd QUALIFY row_number() OVER (PARTITION BY s ORDER BY dd, d) = 1) t JOIN px p ON p.s = t.s GROUP BY t.s, t.dd, t.d, t.peak", "px"), _DD))
register("drawdown_table", lambda v: M.drawdown_table(v.px, "s", "d", "x").withColumn("rank", F.col("rank").cast("long")), _after(with_views("##SELECT s, peak_t, trough_t, recovery_t, round(depth, 6) AS depth, rank FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY depth, peak_t) AS rank FROM (SELECT s, id, min(d) AS peak_t, arg_min(d, (dd, d)) AS trough_t, arg_max_null(nx, d) AS recovery_t, min(dd) AS depth FROM (SELECT *, sum((dd >= 0)::INT) OVER (PARTITION BY s ORDER BY d ROWS UNBOUNDED PRECEDING) AS id, lead(d) OVER (PARTITION BY s ORDER BY d) AS nx FROM dd) GROUP BY s, id HAVING min(dd) < 0)) WHERE rank <= 5", "px"), _DD))
register("ulcer_index", lambda v: M.ulcer_index(v.px, "s", "d", "x"), _after(with_views("##SELECT s, round(sqrt(avg(pow(100 * dd, 2))), 6) AS ulcer, round(100 * avg(g) / sqrt(avg(pow(100 * dd, 2))), 6) AS upi FROM (SELECT *, ln(x / lag(x) OVER (PARTITION BY s ORDER BY d)) AS g FROM dd) GROUP BY s", "px"), _DD))
register("contribution", lambda v: M.contribution(v.panel.withColumn("g", F.col("name") % 4), "name", "t", "g", "f", "fwd").select("level", "asset", "bar", "grp", "pnl"), with_views("SELECT CASE WHEN grouping(name) = 0 THEN 'asset' WHEN grouping(t) = 0 THEN 'bar' WHEN grouping(g) = 0 THEN 'group' ELSE 'total' END AS level, name AS asset, t AS bar, g AS grp, round(sum(coalesce(f * CASE WHEN isfinite(fwd) THEN fwd END, 0)), 8) AS pnl FROM (SELECT *, name % 4 AS g FROM panel) GROUP BY GROUPING SETS ((name), (t), (g), ())", "panel"), 8)

# -- bars ----------------------------------------------------------------------
for _name, _col, _sql in (
    ("parkinson", lambda: M.parkinson(F.col("h"), F.col("l")), "sqrt(avg(pow(ln(h / l), 2)) / (4 * ln(2)))"),
    ("garmanklass", lambda: M.garmanklass(F.col("o"), F.col("h"), F.col("l"), F.col("c")), "sqrt(avg(0.5::DOUBLE * pow(ln(h / l), 2) - (2 * ln(2) - 1) * pow(ln(c / o), 2)))"),
    ("rogerssatchell", lambda: M.rogerssatchell(F.col("o"), F.col("h"), F.col("l"), F.col("c")), "sqrt(avg(ln(h / o) * ln(h / c) + ln(l / o) * ln(l / c)))"),
):
    register(_name, lambda v, c=_col: v.bars.filter("l > 0").groupBy("s").agg(c().alias("vol")), with_views(f"SELECT s, round({_sql}, 6) AS vol FROM bars WHERE l > 0 GROUP BY s", "bars"))
register("yangzhang", lambda v: M.yangzhang(v.bars.filter("l > 0"), "s", by_series(), "o", "h", "l", "c"), with_views("SELECT s, round(sqrt(var_samp(ln(o / pc)) + 0.34::DOUBLE / (1.34 + (count(*) + 1) / (count(*) - 1)) * var_samp(ln(c / o)) + (1 - 0.34::DOUBLE / (1.34 + (count(*) + 1) / (count(*) - 1))) * avg(ln(h / o) * ln(h / c) + ln(l / o) * ln(l / c))), 6) AS vol FROM (SELECT *, lag(c) OVER (PARTITION BY s ORDER BY d) AS pc FROM bars WHERE l > 0) WHERE pc IS NOT NULL GROUP BY s", "bars"))

# -- tails ---------------------------------------------------------------------
register("tailindex", lambda v: M.tailindex(v.ticks, "symbol", "px"), with_views("SELECT symbol, round(list_sum(list_transform(a[1:k], lambda x: ln(x))) / k - ln(a[k + 1]), 6) AS tail FROM (SELECT symbol, list(px ORDER BY px DESC) AS a, greatest(10, ceil(0.1::DOUBLE * count(*)))::INT AS k FROM ticks WHERE px > 0 GROUP BY symbol)", "ticks"))
register("evtvar", lambda v: M.evtvar(v.ret, "s", "r"), _after(with_views("##SELECT s, round(u, 6) AS u, round(xi, 6) AS xi, round(sc, 6) AS scale, round(var, 6) AS var, round((var + sc - xi * u) / (1 - xi), 6) AS es FROM (SELECT *, u + sc / xi * (pow((1 - 0.99::DOUBLE) / (nu / n), -xi) - 1) AS var FROM (SELECT *, 0.5::DOUBLE * (1 - m * m / vv) AS xi, 0.5::DOUBLE * m * (m * m / vv + 1) AS sc FROM ev))", "ret"), "ev AS (SELECT s, any_value(u) AS u, avg(CASE WHEN loss > u THEN loss - u END) AS m, var_samp(CASE WHEN loss > u THEN loss - u END) AS vv, count(CASE WHEN loss > u THEN 1 END) AS nu, count(*) AS n FROM (SELECT s, -r AS loss, quantile_cont(-r, 0.9) OVER (PARTITION BY s) AS u FROM ret) GROUP BY s)"))
register("mes", lambda v: M.mes(v.both, "a", "b"), with_views("SELECT round(-avg(a), 6) AS mes, count(*) AS n FROM both_ WHERE b <= (SELECT quantile_cont(b, 0.05) FROM both_)", "both"))

# -- tests ---------------------------------------------------------------------
_P = "pv AS (SELECT c_custkey AS id, (c_custkey * 7919 % 10007) / 10007.0::DOUBLE * ((c_custkey * 104729 % 10009) / 10009.0::DOUBLE) AS p FROM customer)"
for _method, _sql in (
    ("bonferroni", "p * n"),
    ("holm", "max(p * (n - i + 1)) OVER (ORDER BY p, id ROWS UNBOUNDED PRECEDING)"),
    ("bh", "min(p * n / i) OVER (ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"),
):
    register(f"mht_{_method}", lambda v, m=_method: M.mht_correction(v.table("customer").select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") * 7919 % 10007) / 10007.0 * ((F.col("c_custkey") * 104729 % 10009) / 10009.0)).alias("p")), "p", "id", m), f"WITH {_P} SELECT id, round(p, 6) AS p, round(least(1, {_sql}), 6) AS adjusted FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY p, id) AS i FROM pv)")
_AC = "ac AS (SELECT s, count(*) AS n, " + ", ".join(f"sum(e * l{k}) / sum(e * e) AS r{k}" for k in range(1, 6)) + " FROM (SELECT s, e, " + ", ".join(f"lag(e, {k}) OVER (PARTITION BY s ORDER BY d) AS l{k}" for k in range(1, 6)) + " FROM (SELECT s, d, r - avg(r) OVER (PARTITION BY s) AS e FROM ret)) GROUP BY s)"
register("ljungbox", lambda v: M.ljungbox(v.ret, "s", by_series(), "r", 5), _after(with_views("##SELECT s, round(q, 5) AS q, n, round(" + sql_chi2sf("q", 5) + ", 5) AS p_value FROM (SELECT s, n * (n + 2) * (" + " + ".join(f"r{k} * r{k} / (n - {k})" for k in range(1, 6)) + ") AS q, n FROM ac)", "ret"), _AC), 5)
register("boxpierce", lambda v: M.boxpierce(v.ret, "s", by_series(), "r", 5), _after(with_views("##SELECT s, round(q, 5) AS q, n, round(" + sql_chi2sf("q", 5) + ", 5) AS p_value FROM (SELECT s, n * (" + " + ".join(f"r{k} * r{k}" for k in range(1, 6)) + ") AS q, n FROM ac)", "ret"), _AC), 5)
register("durbinwatson", lambda v: M.durbinwatson(v.ret, "s", by_series(), "r"), with_views("SELECT s, round(sum(e * e) / sum(r * r), 6) AS dw FROM (SELECT s, r, r - lag(r) OVER (PARTITION BY s ORDER BY d) AS e FROM ret) GROUP BY s", "ret"))
register("andersondarling", lambda v: M.andersondarling(v.px, "s", "x"), _after(with_views(f"##SELECT s, round(a, 5) AS a2, n, round(t, 5) AS adjusted, round(CASE WHEN t < 0.2 THEN 1 - exp(-13.436 + 101.14 * t - 223.73 * t * t) WHEN t < 0.34 THEN 1 - exp(-8.318 + 42.796 * t - 59.938 * t * t) WHEN t < 0.6 THEN exp(0.9177 - 4.279 * t - 1.38 * t * t) ELSE exp(1.2937 - 5.709 * t + 0.0186 * t * t) END, 5) AS p_value FROM (SELECT *, a * (1 + 0.75::DOUBLE / n + 2.25::DOUBLE / (n * n)) AS t FROM (SELECT s, -count(*) - sum((2 * i - 1) / n * ln({sql_normcdf('z')}) + (2 * (n - i) + 1) / n * ln({sql_normcdf('y')})) AS a, count(*) AS n FROM zs GROUP BY s))", "px"), "zs AS (SELECT s, z, -z AS y, row_number() OVER (PARTITION BY s ORDER BY z) AS i, count(*) OVER (PARTITION BY s) AS n FROM (SELECT s, (x - avg(x) OVER (PARTITION BY s)) / stddev_samp(x) OVER (PARTITION BY s) AS z FROM px))"), 5)
register("varianceratio", lambda v: M.varianceratio(v.px, "s", by_series(), "x", 2), with_views("SELECT s, round(vr, 5) AS vr, round((vr - 1) / sqrt(2 * 3 * 1 / (6.0::DOUBLE * n)), 5) AS z FROM (SELECT s, count(a) AS n, (sum(pow(b - 2 * m, 2)) / (2 * (count(a) - 1) * (1 - 2 / count(a)))) / (sum(pow(a - m, 2)) / (count(a) - 1)) AS vr FROM (SELECT *, avg(a) OVER (PARTITION BY s) AS m FROM (SELECT s, x - lag(x) OVER (PARTITION BY s ORDER BY d) AS a, x - lag(x, 2) OVER (PARTITION BY s ORDER BY d) AS b FROM px)) GROUP BY s)", "px"), 5)
register("spearmanrank", lambda v: M.spearmanrank(v.both, "a", "b"), _after(with_views("##SELECT round(corr(a, b), 6) AS rho, count(*) AS n FROM (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS a, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS b FROM both_)", "both"), "one AS (SELECT 1)"))
register("chatterjeexi", lambda v: M.chatterjeexi(v.both, "a", "b", "d"), _after(with_views(f"##SELECT round(xi, 6) AS xi, n, round(2 * {sql_normcdf('(-abs(xi) * sqrt(2.5::DOUBLE * n))')}, 6) AS p_value FROM (SELECT 1 - 3 * sum(abs(nx - r)) / (pow(count(*), 2) - 1) AS xi, count(*) AS n FROM (SELECT r, lead(r) OVER (ORDER BY a, d) AS nx FROM (SELECT a, d, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS r FROM both_)))", "both"), "one AS (SELECT 1)"))
register("downsidecorr", lambda v: M.downsidecorr(v.both, "a", "b"), with_views("SELECT round(corr(a, b), 6) AS corr, count(*) AS n FROM both_ WHERE a < 0 AND b < 0", "both"))
_NW = "ft AS (SELECT regr_slope(a, b) AS be, regr_intercept(a, b) AS al FROM both_), er AS (SELECT d, b, a - al - be * b AS e, (a - al - be * b) * b AS v FROM both_, ft), lg AS (SELECT *, " + ", ".join(f"lag(e, {k}) OVER (ORDER BY d) AS e{k}, lag(v, {k}) OVER (ORDER BY d) AS v{k}" for k in (1, 2)) + " FROM er), sm AS (SELECT count(*)::DOUBLE AS n, sum(b) AS sx, sum(b * b) AS sxx, sum(e * e + 2 * 2 / 3.0::DOUBLE * coalesce(e * e1, 0) + 2 / 3.0::DOUBLE * coalesce(e * e2, 0)) AS ee, sum(e * v + 2 / 3.0::DOUBLE * coalesce(e * v1 + v * e1, 0) + 1 / 3.0::DOUBLE * coalesce(e * v2 + v * e2, 0)) AS ev, sum(v * v + 4 / 3.0::DOUBLE * coalesce(v * v1, 0) + 2 / 3.0::DOUBLE * coalesce(v * v2, 0)) AS vv FROM lg)"
register("neweywestse", lambda v: M.neweywestse(v.both, "d", "a", "b", 2), _after(with_views("##SELECT round(al, 6) AS alpha, round(be, 6) AS beta, round(sqrt((sxx * sxx * ee - 2 * sx * sxx * ev + sx * sx * vv) / pow(n * sxx - sx * sx, 2)), 6) AS se_alpha, round(sqrt((sx * sx * ee - 2 * n * sx * ev + n * n * vv) / pow(n * sxx - sx * sx, 2)), 6) AS se_beta FROM sm, ft", "both"), _NW))
register("iv", lambda v: M.iv(v.both.withColumn("z", F.col("b") + F.dayofyear("d") / 1000), "a", "b", "z").withColumn("first_stage_f", F.round("first_stage_f", 2)), with_views("SELECT round(be, 6) AS beta, round(my - be * mx, 6) AS alpha, round(rho * rho * (n - 2) / (1 - rho * rho), 2) AS first_stage_f, n FROM (SELECT covar_samp(z, a) / covar_samp(z, b) AS be, avg(a) AS my, avg(b) AS mx, corr(z, b) AS rho, count(*) AS n FROM (SELECT *, b + dayofyear(d) / 1000 AS z FROM both_))", "both"))
register("rdd", lambda v: M.rdd(v.px.select(F.dayofyear("d").cast("double").alias("k"), "x"), "k", "x", 180.0).select("effect", "left", "right_level", "bandwidth"), with_views("SELECT round(max(lv) FILTER (rt) - max(lv) FILTER (NOT rt), 4) AS effect, round(max(lv) FILTER (NOT rt), 4) AS \"left\", round(max(lv) FILTER (rt), 4) AS right_level, round(max(h), 4) AS bandwidth FROM (SELECT rt, any_value(h) AS h, (sum(w * c * c) * sum(w * x) - sum(w * c) * sum(w * c * x)) / (sum(w) * sum(w * c * c) - pow(sum(w * c), 2)) AS lv FROM (SELECT *, 1 - abs(c) / h AS w, c >= 0 AS rt FROM (SELECT x, dayofyear(d) - 180 AS c, h FROM px, (SELECT 1.5::DOUBLE * stddev_samp(dayofyear(d)) * pow(count(*), -0.2::DOUBLE) AS h FROM px))) WHERE w > 0 GROUP BY rt)", "px"), 4)
register("accelerationscan", lambda v: A.accelerationscan(v.px, "s", "d", "x", [1, 5]), with_views("SELECT s, k AS smoothing, round(corr(a, x), 6) AS corr, count(a) AS n FROM (SELECT s, x, 1 AS k, a FROM ac UNION ALL SELECT s, x, 5, CASE WHEN count(a) OVER w = 5 THEN avg(a) OVER w END FROM ac WINDOW w AS (PARTITION BY s ORDER BY d ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) WHERE a IS NOT NULL GROUP BY s, k", "px").replace(" SELECT s, k AS", ", ac AS (SELECT s, d, x, x - 2 * lag(x) OVER (PARTITION BY s ORDER BY d) + lag(x, 2) OVER (PARTITION BY s ORDER BY d) AS a FROM px) SELECT s, k AS", 1))
