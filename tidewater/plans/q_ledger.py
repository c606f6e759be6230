"""Queries of listings, fills, books, equity and rotations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ledger as L
from ..operators.rolling import rollmean, rollrank
from .catalogue import register
from .views import Views, by_series, with_views

_ACTIONS = "element_at(array('close_at_last', 'mark_to_zero', 'prorate'), CAST(c_custkey % 3 AS INT) + 1)"


def _prices(v: Views):
    return v.table("orders").groupBy(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("d")).agg(F.avg("o_totalprice").alias("p"))


def _lives(v: Views):
    return v.table("customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.to_date(F.lit("1996-01-01")).alias("listing"), F.when(F.col("c_custkey") % 4 == 0, F.to_date(F.lit("1999-06-30"))).alias("delisting"), F.expr(_ACTIONS).alias("action"), F.lit(0.4).alias("recovery"))


_SQL = "pr AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) AS p FROM orders GROUP BY 1, 2), lv AS (SELECT c_custkey AS k, DATE '1996-01-01' AS listing, CASE WHEN c_custkey % 4 = 0 THEN DATE '1999-06-30' END AS delisting, (['close_at_last', 'mark_to_zero', 'prorate'])[c_custkey % 3 + 1] AS action, 0.4::DOUBLE AS recovery FROM customer WHERE c_custkey % 2 = 0), tr AS (SELECT pr.*, lv.delisting, lv.action, lv.recovery, coalesce(d >= listing, true) AND coalesce(d <= delisting, true) AS ok FROM pr LEFT JOIN lv USING (k))"
register("tradeable_mask", lambda v: L.tradeable(_prices(v), _lives(v), "k", "d").select("k", "d", "tradeable"), f"WITH {_SQL} SELECT k, d, ok AS tradeable FROM tr")
register("apply_lifecycle", lambda v: L.apply_lifecycle(_prices(v), _lives(v), "k", "d", "p"), f"WITH {_SQL} SELECT k, d, round(CASE WHEN ok THEN p END, 6) AS p, ok AS tradeable FROM tr")
register("lifecycle_returns", lambda v: L.lifecycle_returns(_prices(v), _lives(v), "k", "d", "p").select("k", "d", "ret"), f"WITH {_SQL} SELECT k, d, round(CASE WHEN gone THEN CASE WHEN i = 1 THEN CASE action WHEN 'close_at_last' THEN 0 WHEN 'mark_to_zero' THEN -1 ELSE recovery - 1 END END ELSE x / lag(x) OVER (PARTITION BY k ORDER BY d) - 1 END, 6) + 0.0::DOUBLE AS ret FROM (SELECT *, CASE WHEN ok THEN p END AS x, coalesce(d > delisting, false) AS gone, sum(coalesce(d > delisting, false)::INT) OVER (PARTITION BY k ORDER BY d) AS i FROM tr)")
register("detect_delistings", lambda v: L.detect_delistings(_prices(v), "k", "d", "p", 100), f"WITH {_SQL}, dy AS (SELECT d, row_number() OVER (ORDER BY d) AS i FROM (SELECT DISTINCT d FROM pr)) SELECT k, delisting FROM (SELECT k, max(d) AS delisting FROM pr GROUP BY k) JOIN dy ON dy.d = delisting WHERE (SELECT max(i) FROM dy) - i >= 100")

_ADV = "av AS (SELECT o_orderstatus AS s, CAST(o_orderdate AS DATE) AS d, CASE WHEN dayofyear(CAST(o_orderdate AS DATE)) % 11 = 0 THEN 0 ELSE sum(o_totalprice) / 100 END AS adv FROM orders GROUP BY 1, 2 HAVING dayofyear(CAST(o_orderdate AS DATE)) % 13 <> 0), od AS (SELECT o_orderkey AS id, o_orderstatus AS s, CAST(o_orderdate AS DATE) AS d, (o_custkey % 1000) * (CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS size, o_totalprice AS price FROM orders)"
_FILL = "fl AS (SELECT *, CASE WHEN reason IN ('OK', 'CAPPED_PARTICIPATION') THEN sign(size) * least(abs(size), adv * 0.1::DOUBLE) ELSE 0 END AS filled FROM (SELECT od.*, av.adv, CASE WHEN av.d IS NULL THEN 'MISSING_DATE' WHEN adv <= 0 THEN 'NO_LIQUIDITY' WHEN least(abs(size), adv * 0.1::DOUBLE) < 1 THEN 'BELOW_MIN_SIZE' WHEN abs(size) > adv * 0.1::DOUBLE THEN 'CAPPED_PARTICIPATION' ELSE 'OK' END AS reason FROM od LEFT JOIN av ON od.s = av.s AND od.d = av.d))"


def _adv(v: Views):
    day = F.dayofyear("d")
    volume = v.table("orders").groupBy(F.col("o_orderstatus").alias("s"), F.to_date("o_orderdate").alias("d")).agg((F.sum("o_totalprice") / 100).alias("adv"))
    return volume.filter(day % 13 != 0).withColumn("adv", F.when(day % 11 == 0, 0.0).otherwise(F.col("adv")))


def _orders(v: Views):
    return v.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"), F.to_date("o_orderdate").alias("d"), (F.col("o_custkey") % 1000 * F.when(F.col("o_orderkey") % 2 == 0, 1.0).otherwise(-1.0)).alias("size"), F.col("o_totalprice").alias("price"))


for _name, _model, _slip in (("flat", lambda: L.flat_slippage(3.14159), "0.000314159::DOUBLE"), ("linear", lambda: L.linear_impact(10.0), "0.001::DOUBLE * abs(filled) / nullif(adv, 0)"), ("square_root", lambda: L.square_root_impact(10.0), "0.001::DOUBLE * sqrt(abs(filled) / nullif(adv, 0))")):
    register(f"execute_fill_{_name}", lambda v, m=_model: L.execute_fills(_orders(v), _adv(v), "s", "d", m()).select("id", "reason", "filled", (F.col("slippage") * 10000).alias("slippage_bps"), "fill_price", F.log(F.nullif(F.col("cost"), F.lit(0.0))).alias("log_cost")), f"WITH {_ADV}, {_FILL} SELECT id, reason, round(filled, 3) + 0.0::DOUBLE AS filled, round(10000 * CASE WHEN filled <> 0 THEN {_slip} ELSE 0 END, 3) + 0.0::DOUBLE AS slippage_bps, round(price * (1 + sign(filled) * CASE WHEN filled <> 0 THEN {_slip} ELSE 0 END), 3) AS fill_price, round(ln(nullif(abs(filled) * price * (1 + sign(filled) * CASE WHEN filled <> 0 THEN {_slip} ELSE 0 END), 0)), 3) AS log_cost FROM fl", 3)
register("liquidity_mask", lambda v: L.liquidity_mask(v.px, _adv(v), "s", "d", 1000.0).select("s", "d", "liquid"), with_views("##", "px").replace("WITH ", f"WITH {_ADV}, ").replace("##", "SELECT px.s, px.d, coalesce(adv > 1000, false) AS liquid FROM px LEFT JOIN av ON px.s = av.s AND px.d = av.d"))
register("position_book", lambda v: L.book(v.table("orders").select("o_custkey", "o_orderdate", "o_orderkey", (F.col("o_orderkey") % 50 * F.when(F.col("o_orderkey") % 3 == 0, -2.0).otherwise(1.0)).alias("filled"), F.col("o_totalprice").alias("fill_price")), "o_custkey", ["o_orderdate", "o_orderkey"]), "WITH RECURSIVE f AS (SELECT o_custkey, (o_orderkey % 50) * (CASE WHEN o_orderkey % 3 = 0 THEN -2 ELSE 1 END)::DOUBLE AS q, o_totalprice AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders), b AS (SELECT o_custkey, 0::BIGINT AS i, 0.0::DOUBLE AS pos, 0.0::DOUBLE AS cost, 0.0::DOUBLE AS gain FROM (SELECT DISTINCT o_custkey FROM f) UNION ALL SELECT f.o_custkey, f.i, b.pos + q, CASE WHEN q = 0 THEN cost WHEN b.pos + q = 0 THEN 0 WHEN b.pos * q >= 0 THEN (b.pos * cost + q * p) / (b.pos + q) WHEN b.pos * (b.pos + q) > 0 THEN cost ELSE p END, gain + CASE WHEN b.pos * q >= 0 THEN 0 ELSE least(abs(b.pos), abs(q)) * sign(b.pos) * (p - cost) END FROM b JOIN f ON f.o_custkey = b.o_custkey AND f.i = b.i + 1) SELECT b.o_custkey, n AS n_fills, round(pos, 4) + 0.0::DOUBLE AS pos, round(cost, 4) + 0.0::DOUBLE AS avg_cost, round(gain, 4) + 0.0::DOUBLE AS realized FROM b JOIN (SELECT DISTINCT o_custkey, n FROM f) USING (o_custkey) WHERE i = n", 4)
register("equity_curve", lambda v: L.equity(_orders(v).select("s", "d", F.col("size").alias("filled"), F.col("price").alias("fill_price")), v.px.withColumnRenamed("x", "price"), "s", "d", 1e9).select("d", *[(F.col(c) / 1e6).alias(c) for c in ("cash", "value", "total")]), with_views("##", "px").replace("WITH ", f"WITH {_ADV}, ").replace("##", ", fw AS (SELECT s, d, sum(size) AS q, sum(size * price) AS m FROM od GROUP BY 1, 2), hd AS (SELECT d, m, x, sum(q) OVER (PARTITION BY s ORDER BY d ROWS UNBOUNDED PRECEDING) AS pos FROM px LEFT JOIN fw USING (s, d)), dd AS (SELECT d, sum(coalesce(m, 0)) AS m, sum(coalesce(pos, 0) * x) AS value FROM hd GROUP BY d) SELECT d, round((1e9 - sum(m) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING)) / 1e6, 3) AS cash, round(value / 1e6, 3) AS value, round((1e9 - sum(m) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) + value) / 1e6, 3) AS total FROM dd"), 3)

# -- rotations from the first components of vectors ---------------------------------
_VEC = "(SELECT vec_id, label, e[1]::DOUBLE / n AS w, e[2]::DOUBLE / n AS x, e[3]::DOUBLE / n AS y, e[4]::DOUBLE / n AS z FROM (SELECT vec_id, label, embedding AS e, sqrt(embedding[1]::DOUBLE * embedding[1] + embedding[2]::DOUBLE * embedding[2] + embedding[3]::DOUBLE * embedding[3] + embedding[4]::DOUBLE * embedding[4]) AS n FROM embeddings))"


def _vec(v: Views):
    e = lambda k: F.element_at("embedding", k).cast("double")
    return v.table("embeddings").select("vec_id", "label", L.quat_normalize(L.quaternion(e(1), e(2), e(3), e(4))).alias("q"))


def _two(v: Views):
    return _vec(v).withColumn("p", F.lag("q").over(Window.partitionBy("label").orderBy("vec_id"))).filter("p IS NOT NULL")


_PAIR = "(SELECT * FROM (SELECT *, lag(w) OVER o AS a, lag(x) OVER o AS b, lag(y) OVER o AS c, lag(z) OVER o AS d FROM " + _VEC + " WINDOW o AS (PARTITION BY label ORDER BY vec_id)) WHERE a IS NOT NULL)"
_OUT = ("w", "x", "y", "z")


def _quat(name: str, build, values: tuple[str, ...], pairs: bool = True, digits: int = 5) -> None:
    register(name, lambda v: (_two(v) if pairs else _vec(v)).select("vec_id", build().alias("r")).select("vec_id", *[f"r.{c}" for c in _OUT]), f"SELECT vec_id, {', '.join(f'round({e}, {digits}) + 0.0::DOUBLE AS {c}' for c, e in zip(_OUT, values))} FROM {_PAIR if pairs else _VEC}", digits)


_quat("quat_multiply", lambda: L.quat_multiply(F.col("p"), F.col("q")), ("a * w - b * x - c * y - d * z", "a * x + b * w + c * z - d * y", "a * y - b * z + c * w + d * x", "a * z + b * y - c * x + d * w"))
_quat("quat_conjugate", lambda: L.quat_conjugate(F.col("q")), ("w", "-x", "-y", "-z"), False)
_quat("quat_normalize", lambda: L.quat_normalize(F.col("q")), ("w", "x", "y", "z"), False)
register("quat_angle", lambda v: _vec(v).select("vec_id", L.quat_angle(F.col("q")).alias("v")), f"SELECT vec_id, round(2 * acos(least(1, abs(w))), 5) AS v FROM {_VEC}", 5)
register("quaternion_distance", lambda v: _two(v).select("vec_id", L.quaternion_distance(F.col("p"), F.col("q")).alias("v")), f"SELECT vec_id, round(2 * acos(least(1, abs(a * w + b * x + c * y + d * z))), 5) AS v FROM {_PAIR}", 5)
_DOT = "(a * w + b * x + c * y + d * z)"
_TH = f"acos(least(1, abs({_DOT})))"
_U, _V = f"sin(0.7 * {_TH}) / sin({_TH})", f"sin(0.3 * {_TH}) / sin({_TH}) * (CASE WHEN {_DOT} < 0 THEN -1 ELSE 1 END)"
_quat("slerp", lambda: L.slerp(F.col("p"), F.col("q"), 0.3), tuple(f"({_U} * {m} + {_V} * {n})" for m, n in zip("abcd", "wxyz")))
register("composerotations", lambda v: L.composerotations(_vec(v), "label", "vec_id", "q").select("label", *[f"q.{c}" for c in _OUT]), f"WITH RECURSIVE q AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i, count(*) OVER (PARTITION BY label) AS n FROM {_VEC}), r AS (SELECT label, i, n, w, x, y, z FROM q WHERE i = 1 UNION ALL SELECT q.label, q.i, q.n, q.w * r.w - q.x * r.x - q.y * r.y - q.z * r.z, q.w * r.x + q.x * r.w + q.y * r.z - q.z * r.y, q.w * r.y - q.x * r.z + q.y * r.w + q.z * r.x, q.w * r.z + q.x * r.y - q.y * r.x + q.z * r.w FROM r JOIN q ON q.label = r.label AND q.i = r.i + 1) SELECT label, round(w, 6) + 0.0::DOUBLE AS w, round(x, 6) + 0.0::DOUBLE AS x, round(y, 6) + 0.0::DOUBLE AS y, round(z, 6) + 0.0::DOUBLE AS z FROM r WHERE i = n")
register("rollholonomy", lambda v: _vec(v).select("vec_id", L.rollholonomy(F.col("q"), 2, Window.partitionBy("label").orderBy("vec_id")).alias("v")), f"SELECT vec_id, round(CASE WHEN a IS NOT NULL THEN 2 * acos(least(1, abs(w * a - x * b - y * c - z * d))) END, 5) AS v FROM (SELECT *, lag(w) OVER o AS a, lag(x) OVER o AS b, lag(y) OVER o AS c, lag(z) OVER o AS d FROM {_VEC} WINDOW o AS (PARTITION BY label ORDER BY vec_id))", 5)
register("posteriorentropy", lambda v: v.table("embeddings").select("vec_id", F.transform("embedding", lambda e: e.cast("double") * e.cast("double")).alias("g")).select("vec_id", F.transform("g", lambda e: e / F.aggregate("g", F.lit(0.0), lambda a, b: a + b)).alias("g")).select("vec_id", L.posteriorentropy(F.col("g")).alias("h")), "SELECT vec_id, round(-list_sum(list_transform(g, lambda p: CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END)), 6) AS h FROM (SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE * e::DOUBLE / list_sum(list_transform(embedding, lambda f: f::DOUBLE * f::DOUBLE))) AS g FROM embeddings)")

register("submit_order", lambda v: L.submit(L.execute_fills(_orders(v).withColumn("kind", F.when(F.col("id") % 10 == 0, "LIMIT").otherwise("MARKET")), _adv(v), "s", "d", L.flat_slippage(3.14159)), "kind").select("id", "status"), f"WITH {_ADV}, {_FILL} SELECT id, CASE WHEN id % 10 = 0 THEN 'REJECTED' WHEN reason = 'OK' THEN 'FILLED' WHEN reason = 'CAPPED_PARTICIPATION' THEN 'PARTIAL' ELSE 'REJECTED' END AS status FROM fl")
register("indicators", lambda v: L.Warmup(v.px, "s", "d").add("mean20", lambda by: rollmean(F.col("x"), 20, by)).add("rank20", lambda by: rollrank(F.col("x"), 20, by)).materialize().select("s", "d", "mean20", "rank20"), with_views("SELECT s, d, round(CASE WHEN count(x) OVER w = 20 THEN avg(x) OVER w END, 6) AS mean20, round(CASE WHEN count(x) OVER w = 20 THEN len(list_filter(list(x) OVER w, lambda v: v < x)) + (len(list_filter(list(x) OVER w, lambda v: v = x)) + 1) / 2.0::DOUBLE END, 6) AS rank20 FROM px WINDOW w AS (PARTITION BY s ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)", "px"))
