"""Queries of the rolling windows over daily prices with holes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rolling as R
from .catalogue import register
from .views import by_series, with_views

W = 20
_FRAME = f"OVER (PARTITION BY s ORDER BY d ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW)"


def _one(name: str, column, sql: str, digits: int = 6, pair: bool = False) -> None:
    """sql: the value over frame {f}; strict in x, or in x and y."""
    counted = f"count(x) {_FRAME} = {W}"
    body = f"SELECT s, d, round(CASE WHEN {counted} THEN {sql.replace('{f}', _FRAME)} END, {digits}) + 0.0::DOUBLE AS v FROM holes"
    register(name, lambda v: v.holes.select("s", "d", column(F.col("x"), F.col("y"), by_series()).alias("v")), with_views(body, "holes"), digits)


_LIST = f"list(x) {_FRAME}"
_one("rollsum", lambda X, Y, by: R.rollsum(X, W, by), "sum(x) {f}", 4)
_one("rollmean", lambda X, Y, by: R.rollmean(X, W, by), "avg(x) {f}")
_one("rollmin", lambda X, Y, by: R.rollmin(X, W, by), "min(x) {f}")
_one("rollmax", lambda X, Y, by: R.rollmax(X, W, by), "max(x) {f}")
_one("rollrange", lambda X, Y, by: R.rollrange(X, W, by), "max(x) {f} - min(x) {f}")
_one("rollstd", lambda X, Y, by: R.rollstd(X, W, by), "stddev_samp(x) {f}", 5)
_one("zscore", lambda X, Y, by: R.zscore(X, W, by), "(x - avg(x) {f}) / nullif(stddev_samp(x) {f}, 0)")
_one("rollskew", lambda X, Y, by: R.rollskew(X, W, by), "skewness(x) {f}")
_one("rollkurt", lambda X, Y, by: R.rollkurt(X, W, by), "kurtosis(x) {f}")
_one("rollquantile", lambda X, Y, by: R.rollquantile(X, W, by, 0.3), "quantile_cont(x, 0.3) {f}", 8)
_one("rollmedian", lambda X, Y, by: R.rollmedian(X, W, by), "quantile_cont(x, 0.5) {f}", 8)
_one("rollpercentile", lambda X, Y, by: R.rollpercentile(X, W, by, 90), "quantile_cont(x, 0.9) {f}", 8)
_one("rollmad", lambda X, Y, by: R.rollmad(X, W, by), "mad(x) {f}", 8)
_one("rollrank", lambda X, Y, by: R.rollrank(X, W, by), f"len(list_filter({_LIST}, lambda v: v < x)) + (len(list_filter({_LIST}, lambda v: v = x)) + 1) / 2.0::DOUBLE")
_one("rollsharpe", lambda X, Y, by: R.rollsharpe(X, W, by, 252.0, 1000.0), "(avg(x) {f} - 1000) * sqrt(252) / nullif(stddev_samp(x) {f}, 0)")
_one("rollcov", lambda X, Y, by: R.rollcov(X, Y, W, by), "covar_samp(x, y) {f}", 0)
_one("rollcorr", lambda X, Y, by: R.rollcorr(X, Y, W, by), "corr(x, y) {f}")
_one("rollbeta", lambda X, Y, by: R.rollbeta(X, Y, W, by), "regr_slope(y, x) {f}")
_one("rollidio", lambda X, Y, by: R.rollidio(Y, X, W, by), "CASE WHEN count(x) {f} = 20 THEN stddev_samp(y) {f} * CASE WHEN 1 - corr(x, y) {f} * corr(x, y) {f} >= 1e-12 THEN sqrt(1 - corr(x, y) {f} * corr(x, y) {f}) ELSE 0 END END", 3)

for _name, _column, _sql in (("rollargmax", R.rollargmax, "max"), ("rollargmin", R.rollargmin, "min")):
    register(_name, lambda v, c=_column: v.holes.select("s", "d", c(F.col("x"), W, by_series()).alias("v")), with_views(f"SELECT s, d, CASE WHEN count(x) {_FRAME} = {W} THEN list_position({_LIST}, list_{_sql}({_LIST})) - 1 END::BIGINT AS v FROM holes", "holes"))

_RET = f"OVER (PARTITION BY s ORDER BY d ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW)"
register("rollsortino", lambda v: v.ret.select("s", "d", R.rollsortino(F.col("r"), W, by_series(), 252.0).alias("v")), with_views(f"SELECT s, d, round(CASE WHEN count(r) {_RET} = {W} THEN avg(r) {_RET} * sqrt(252) / nullif(sqrt(avg(least(r, 0) * least(r, 0)) {_RET}), 0) END, 6) + 0.0::DOUBLE AS v FROM ret", "ret"))
_MDD = f"""mdd AS (SELECT s, d, r, CASE WHEN count(r) {_RET} = {W} THEN list(r) {_RET} END AS a FROM ret),
eq AS (SELECT s, d, r, a, list_transform(range(1, 21), lambda i: list_product(list_transform(a[1:i], lambda x: 1 + x))) AS e FROM mdd),
dd AS (SELECT s, d, r, CASE WHEN a IS NOT NULL THEN list_min(list_transform(range(1, 21), lambda i: e[i] / list_max(e[1:i]) - 1)) END AS v FROM eq)"""
register("rollmdd", lambda v: v.ret.select("s", "d", R.rollmdd(F.col("r"), W, by_series()).alias("v")), with_views("SELECT s, d, round(v, 6) + 0.0::DOUBLE AS v FROM dd", "ret").replace(" SELECT s, d, round(v, 6)", f", {_MDD} SELECT s, d, round(v, 6)", 1))
register("rollcalmar", lambda v: v.ret.select("s", "d", R.rollcalmar(F.col("r"), W, by_series(), 252.0).alias("v")), with_views("SELECT s, d, round(m * 252 / nullif(abs(v), 0), 6) + 0.0::DOUBLE AS v FROM dm", "ret").replace(" SELECT s, d, round(m", f", {_MDD}, dm AS (SELECT s, d, v, avg(r) {_RET} AS m FROM dd) SELECT s, d, round(m", 1))
register("rolltailindex", lambda v: v.px.select("s", "d", R.rolltailindex(F.col("x"), 60, by_series()).alias("v")), with_views("SELECT s, d, round(CASE WHEN len(a) = 60 THEN list_sum(list_transform(a[1:10], lambda x: ln(x))) / 10 - ln(a[11]) END, 6) + 0.0::DOUBLE AS v FROM (SELECT s, d, list_reverse_sort(list(x) OVER (PARTITION BY s ORDER BY d ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) AS a FROM px)", "px"))
register("atr", lambda v: R.atr(v.bars, "h", "l", "c", 5, by_series()).select("s", "d", "atr"), with_views("SELECT s, d, round(CASE WHEN count(tr) OVER w = 5 THEN avg(tr) OVER w END, 6) + 0.0::DOUBLE AS atr FROM (SELECT s, d, CASE WHEN pc IS NULL THEN h - l ELSE greatest(h - l, abs(h - pc), abs(l - pc)) END AS tr FROM (SELECT *, lag(c) OVER (PARTITION BY s ORDER BY d) AS pc FROM bars)) WINDOW w AS (PARTITION BY s ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)", "bars"))

_NUMBERED = "n AS (SELECT s, d, x, row_number() OVER (PARTITION BY s ORDER BY d) AS i FROM px)"
register("rollema", lambda v: R.rollema(v.px, "s", "d", "x", span=21).select("s", "d", F.col("ema").alias("v")), f"WITH RECURSIVE {{px}}, {_NUMBERED}, e AS (SELECT s, d, i, x AS v FROM n WHERE i = 1 UNION ALL SELECT n.s, n.d, n.i, n.x * (2.0::DOUBLE / 22) + e.v * (1 - 2.0::DOUBLE / 22) FROM e JOIN n ON n.s = e.s AND n.i = e.i + 1) SELECT s, d, round(v, 6) + 0.0::DOUBLE AS v FROM e".replace("{px}", "px AS (SELECT o_orderstatus AS s, CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) AS x FROM orders GROUP BY 1, 2)"))
register("rollemastd", lambda v: R.rollemastd(v.px, "s", "d", "x", span=21).select("s", "d", F.nullif(F.nanvl("ema_std", F.lit(-1.0)), F.lit(-1.0)).alias("v")), f"WITH RECURSIVE {{px}}, {_NUMBERED}, z AS (SELECT s, d, i, x - first_value(x) OVER (PARTITION BY s ORDER BY d) AS x FROM n), e AS (SELECT s, d, i, x AS m, x * x AS q, 1.0::DOUBLE AS w FROM z WHERE i = 1 UNION ALL SELECT z.s, z.d, z.i, z.x * (2.0::DOUBLE / 22) + e.m * (1 - 2.0::DOUBLE / 22), z.x * z.x * (2.0::DOUBLE / 22) + e.q * (1 - 2.0::DOUBLE / 22), (2.0::DOUBLE / 22) * (2.0::DOUBLE / 22) + e.w * (1 - 2.0::DOUBLE / 22) * (1 - 2.0::DOUBLE / 22) FROM e JOIN z ON z.s = e.s AND z.i = e.i + 1) SELECT s, d, round(CASE WHEN i > 1 THEN sqrt(greatest(q - m * m, 0) / (1 - w)) END, 4) + 0.0::DOUBLE AS v FROM e".replace("{px}", "px AS (SELECT o_orderstatus AS s, CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) AS x FROM orders GROUP BY 1, 2)"), 4)
register("flagship", lambda v: v.holes.select("s", "d", R.rollmean(F.col("x"), W, by_series()).alias("mean"), R.rollmax(F.col("x"), W, by_series()).alias("top"), R.rollcorr(F.col("x"), F.col("y"), W, by_series()).alias("corr")), with_views(f"SELECT s, d, round(CASE WHEN count(x) {_FRAME} = {W} THEN avg(x) {_FRAME} END, 6) AS mean, round(CASE WHEN count(x) {_FRAME} = {W} THEN max(x) {_FRAME} END, 6) AS top, round(CASE WHEN count(x) {_FRAME} = {W} THEN corr(x, y) {_FRAME} END, 6) AS corr FROM holes", "holes"))
