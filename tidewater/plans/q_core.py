"""Queries of distributions, option prices, Greeks and chain filters, row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normal as N
from ..functions import options as O
from ..operators import chains
from .catalogue import register
from .views import Views, with_views

_IDS = ("l_orderkey", "l_linenumber", "l_partkey")


def terms():
    return tuple(F.col(c) for c in ("S", "K", "T", "r", "sigma"))


# -- distributions over order prices -----------------------------------------
_ZSQL = "z AS (SELECT o_orderkey, (o_totalprice - 250000) / 60000 AS z, (o_orderkey % 997 + 0.5) / 997.0::DOUBLE AS p FROM orders)"


def _z(v: Views):
    return v.table("orders").select("o_orderkey", ((F.col("o_totalprice") - 250000) / 60000).alias("z"), ((F.col("o_orderkey") % 997 + 0.5) / 997.0).alias("p"))


def _scalar(name: str, column, sql: str, digits: int = 9) -> None:
    register(name, lambda v: _z(v).select("o_orderkey", column(F.col("z"), F.col("p")).alias("v")), f"WITH {_ZSQL} SELECT o_orderkey, round({sql}, {digits}) + 0.0::DOUBLE AS v FROM z", digits)


_scalar("normcdf", lambda z, p: N.normcdf(z), N.sql_normcdf("z"))
_scalar("normpdf", lambda z, p: N.normpdf(z), "exp(-z * z / 2) / sqrt(2 * pi())")
_scalar("normppf", lambda z, p: N.normppf(p), N.sql_normppf("p"))
_scalar("lognormcdf", lambda z, p: N.lognormcdf(z), f"ln({N.sql_normcdf('z')})", 8)
_scalar("lognormccdf", lambda z, p: N.lognormccdf(z), f"ln(1 - {N.sql_normcdf('z')})", 8)
_scalar("gpdpdf", lambda z, p: N.gpdpdf(z, F.lit(0.3), F.lit(1.5)), "CASE WHEN z < 0 THEN 0 ELSE pow(1 + 0.3::DOUBLE * z / 1.5, -1 / 0.3::DOUBLE - 1) / 1.5 END")
_scalar("gpdcdf", lambda z, p: N.gpdcdf(z, F.lit(-0.2), F.lit(1.5)), "CASE WHEN z < 0 THEN 0 WHEN 1 - 0.2::DOUBLE * z / 1.5 <= 0 THEN 1 ELSE 1 - pow(1 - 0.2::DOUBLE * z / 1.5, 1 / 0.2::DOUBLE) END")
_scalar("gpdppf", lambda z, p: N.gpdppf(p, F.lit(0.3), F.lit(1.5)), "1.5::DOUBLE / 0.3 * (pow(1 - p, -0.3::DOUBLE) - 1)")
_scalar("gammaln", lambda z, p: N.gammaln(p * 50), "lgamma(p * 50)", 8)
_scalar("tpdf", lambda z, p: N.tpdf(z, F.lit(5.0)), "exp(lgamma(3.0) - lgamma(2.5) - 0.5 * ln(5 * pi()) - 3 * ln(1 + z * z / 5))")
register("logsumexp", lambda v: N.logsumexp_by(_z(v).withColumn("g", F.col("o_orderkey") % 100), "g", "z"), f"WITH {_ZSQL} SELECT o_orderkey % 100 AS g, round(ln(sum(exp(z))), 8) + 0.0::DOUBLE AS v FROM z GROUP BY 1", 8)

# -- prices and Greeks ---------------------------------------------------------
_D = f"""d AS (SELECT *, S > 0 AND K > 0 AND T > 0 AND sigma > 0 AS ok, (ln(S / K) + (r + sigma * sigma / 2) * T) / (sigma * sqrt(T)) AS d1, (ln(S / K) + (r - sigma * sigma / 2) * T) / (sigma * sqrt(T)) AS d2, exp(-r * T) AS dr FROM opt),
n AS (SELECT *, exp(-d1 * d1 / 2) / sqrt(2 * pi()) AS f1, {N.sql_normcdf('d1')} AS n1, {N.sql_normcdf('d2')} AS n2, sigma * sqrt(T) AS sd FROM d)"""


def _option(name: str, column, sql: str, digits: int = 5) -> None:
    """Interest r, no dividends; sql in terms of S, K, T, r, sigma, d1, d2, n1, n2, f1, sd, dr."""
    body = with_views(f"SELECT {', '.join(_IDS)}, round({sql}, {digits}) + 0.0::DOUBLE AS v FROM n", "opt").replace(" SELECT " + _IDS[0], f", {_D} SELECT {_IDS[0]}", 1)
    register(name, lambda v: v.opt.select(*_IDS, column(*terms()).alias("v")), body, digits)


_CALL, _PUT = "(S * n1 - K * dr * n2)", "(K * dr * (1 - n2) - S * (1 - n1))"
_GAMMA = "(f1 / (S * sd))"
_option("bscall", lambda S, K, T, r, sigma: O.bscall(S, K, T, r, sigma), _CALL)
_option("bsput", lambda S, K, T, r, sigma: O.bsput(S, K, T, r, sigma), _PUT)
_option("bscalldelta", lambda S, K, T, r, sigma: O.bscalldelta(S, K, T, r, sigma), "n1", 8)
_option("bsputdelta", lambda S, K, T, r, sigma: O.bsputdelta(S, K, T, r, sigma), "n1 - 1", 8)
_option("bscallrho", lambda S, K, T, r, sigma: O.bscallrho(S, K, T, r, sigma), "T * K * dr * n2")
_option("bsputrho", lambda S, K, T, r, sigma: O.bsputrho(S, K, T, r, sigma), "-T * K * dr * (1 - n2)")
_option("bscalltheta", lambda S, K, T, r, sigma: O.bscalltheta(S, K, T, r, sigma), "-S * f1 * sigma / (2 * sqrt(T)) - r * K * dr * n2")
_option("bsputtheta", lambda S, K, T, r, sigma: O.bsputtheta(S, K, T, r, sigma), "-S * f1 * sigma / (2 * sqrt(T)) + r * K * dr * (1 - n2)")
_option("bsgamma", lambda S, K, T, r, sigma: O.bsgamma(S, K, T, r, sigma), _GAMMA, 9)
_option("bsvega", lambda S, K, T, r, sigma: O.bsvega(S, K, T, r, sigma), "S * f1 * sqrt(T)")
_option("bsvanna", lambda S, K, T, r, sigma: O.bsvanna(S, K, T, r, sigma), "-f1 * d2 / sigma", 8)
_option("bsvolga", lambda S, K, T, r, sigma: O.bsvolga(S, K, T, r, sigma), "S * f1 * sqrt(T) * d1 * d2 / sigma")
_option("bsspeed", lambda S, K, T, r, sigma: O.bsspeed(S, K, T, r, sigma), f"-{_GAMMA} / S * (d1 / sd + 1)", 9)
_option("bszomma", lambda S, K, T, r, sigma: O.bszomma(S, K, T, r, sigma), f"{_GAMMA} * (d1 * d2 - 1) / sigma", 8)
_option("bscolor", lambda S, K, T, r, sigma: O.bscolor(S, K, T, r, sigma), "-f1 / (2 * S * T * sd) * (1 + (2 * r * T - d2 * sd) * d1 / sd)", 7)
_option("bscallcharm", lambda S, K, T, r, sigma: O.bscallcharm(S, K, T, r, sigma), "-f1 * (2 * r * T - d2 * sd) / (2 * T * sd)", 7)
_option("bsputcharm", lambda S, K, T, r, sigma: O.bsputcharm(S, K, T, r, sigma), "-f1 * (2 * r * T - d2 * sd) / (2 * T * sd)", 7)
_option("callpayoff", lambda S, K, T, r, sigma: O.callpayoff(S, K), "greatest(S - K, 0)", 8)
_option("putpayoff", lambda S, K, T, r, sigma: O.putpayoff(S, K), "greatest(K - S, 0)", 8)
_option("digitalprice", lambda S, K, T, r, sigma: O.digitalprice(S, K, T, r, sigma, cash=10.0), "10 * dr * n2", 7)
_option("gapprice", lambda S, K, T, r, sigma: O.gapprice(S, K, K * 1.1, T, r, sigma), "S * n1 - 1.1::DOUBLE * K * dr * n2", 6)
register("powerprice", lambda v: v.opt.select(*_IDS, (lambda S, K, T, r, sigma: O.powerprice(S, K * K, T, r, sigma))(*terms()).alias("v")), with_views(f"SELECT {', '.join(_IDS)}, round(dr * (fw * {N.sql_normcdf('e1')} - kk * {N.sql_normcdf('e2')}), 1) + 0.0::DOUBLE AS v FROM (SELECT *, (ln(fw / kk) + w * w / 2) / w AS e1, (ln(fw / kk) - w * w / 2) / w AS e2 FROM (SELECT *, K * K AS kk, S * S * exp((2 * r + sigma * sigma) * T) AS fw, 2 * sd AS w FROM n))", "opt").replace(" SELECT " + _IDS[0], f", {_D} SELECT {_IDS[0]}", 1), 1)
_CHOOSE = f"(ln(S / k2) + (r + sigma * sigma / 2) * t2) / (sigma * sqrt(t2))"
register("chooserprice", lambda v: v.opt.select(*_IDS, (lambda S, K, T, r, sigma: O.chooserprice(S, K, T, T / 2, r, sigma))(*terms()).alias("v")), with_views(f"SELECT {', '.join(_IDS)}, round({_CALL} + k2 * exp(-r * t2) * {N.sql_normcdf('m2')} - S * {N.sql_normcdf('m1')}, 5) + 0.0::DOUBLE AS v FROM (SELECT *, -{_CHOOSE} AS m1, -{_CHOOSE} + sigma * sqrt(t2) AS m2 FROM (SELECT *, T / 2 AS t2, K * exp(-r * T / 2) AS k2 FROM n))", "opt").replace(" SELECT " + _IDS[0], f", {_D} SELECT {_IDS[0]}", 1), 5)
_LB = "b AS (SELECT *, CASE WHEN abs(r) < 1e-8 THEN 1e-8::DOUBLE ELSE r END AS c FROM opt WHERE S > 0), a AS (SELECT *, (ln(1 / 0.9::DOUBLE) + (c + sigma * sigma / 2) * T) / (sigma * sqrt(T)) AS a1 FROM b), e AS (SELECT *, a1 - sigma * sqrt(T) AS a2, 2 * c * sqrt(T) / sigma - a1 AS a3, -a1 AS a4 FROM a)"
register("lookbackprice", lambda v: v.opt.filter("S > 0 AND r > 0.001").select(*_IDS, (lambda S, K, T, r, sigma: O.lookbackprice(S, S * 0.9, T, r, sigma))(*terms()).alias("v")), with_views(f"SELECT {', '.join(_IDS)}, round(S * exp((c - r) * T) * {N.sql_normcdf('a1')} - 0.9::DOUBLE * S * exp(-r * T) * {N.sql_normcdf('a2')} + S * exp(-r * T) * sigma * sigma / (2 * c) * (pow(1 / 0.9::DOUBLE, -2 * c / (sigma * sigma)) * {N.sql_normcdf('a3')} - exp(c * T) * {N.sql_normcdf('a4')}), 4) + 0.0::DOUBLE AS v FROM e WHERE r > 0.001", "opt").replace(" SELECT " + _IDS[0], f", {_LB} SELECT {_IDS[0]}", 1), 4)
register("moneynessbucket", lambda v: v.opt.select(*_IDS, (lambda S, K, T, r, sigma: O.moneynessbucket(S, K, T, r))(*terms()).alias("v")), with_views(f"SELECT {', '.join(_IDS)}, CASE WHEN m < -0.10 THEN 'deep_ITM' WHEN m < -0.03 THEN 'ITM' WHEN m < 0.03 THEN 'ATM' WHEN m < 0.10 THEN 'OTM' ELSE 'deep_OTM' END AS v FROM (SELECT *, ln(K / (S * exp(r * T))) AS m FROM opt)", "opt"))


def _priced(v: Views):
    """Options with their prices as a column of data: Spark can't hand expressions with lambdas to a Pandas UDF."""
    made = v.opt.select(*_IDS, "S", "K", "T", "r", "sigma", O.bscall(*terms()).alias("price"))
    return made.mapInArrow(lambda batches: batches, made.schema)


for _name, _fn in (("impvolbisection", O.impvolbisection), ("impvol", O.impvol)):
    # The volatility that a price was made with comes back, of every line; it is compared where a hundredth of volatility moves the price by a hundredth or more.
    register(
        _name,
        lambda v, fn=_fn: _priced(v).select(*_IDS, F.when(O.bsvega(*terms()) > 1, fn(F.col("price"), F.col("S"), F.col("K"), F.col("T"), F.col("r"))).alias("v")),
        with_views(f"SELECT {', '.join(_IDS)}, CASE WHEN S * f1 * sqrt(T) > 1 THEN round(sigma, 5) + 0.0::DOUBLE END AS v FROM n", "opt").replace(" SELECT " + _IDS[0], f", {_D} SELECT {_IDS[0]}", 1),
        5,
    )
register("deltabucket", lambda v: chains.deltabucket(v.opt.select((F.col("l_orderkey") * 100000 + F.col("l_partkey")).alias("id"), O.bscalldelta(*terms()).alias("delta")), "id", "delta", [0.1, 0.25, 0.5, 0.75, 0.9]), with_views(f"SELECT target, round(arg_min(n1, (abs(n1 - target), id)), 8) + 0.0::DOUBLE AS delta, round(min(abs(n1 - target)), 8) + 0.0::DOUBLE AS gap FROM (SELECT unnest([0.1::DOUBLE, 0.25, 0.5, 0.75, 0.9]) AS target, n1, l_orderkey * 100000 + l_partkey AS id FROM n) GROUP BY target", "opt").replace(" SELECT target", f", {_D} SELECT target", 1), 8)
