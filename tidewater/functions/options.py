"""European options, Greeks, payoffs and exotics as Column expressions.

Every function takes Columns (or numbers) S, K, T, r, sigma, q.  Where T,
sigma, S or K isn't positive the limits of the formulas hold, as stated in each
function; other cases without a limit are null.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .normal import normcdf, normpdf


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def _null() -> Column:
    return F.lit(None).cast("double")


class Terms:
    """d1, d2, discounts and the region where the formulas hold; outside it inputs are 1, so nothing overflows."""

    def __init__(self, S, K, T, r, sigma, q=0.0):
        self.S, self.K, self.T, self.r, self.sigma, self.q = map(_c, (S, K, T, r, sigma, q))
        self.ok = (self.T > 0) & (self.sigma > 0) & (self.S > 0) & (self.K > 0)
        safe = lambda x: F.when(self.ok, x).otherwise(1.0)
        self.s, self.k, self.t, self.v = safe(self.S), safe(self.K), safe(self.T), safe(self.sigma)
        self.root = self.v * F.sqrt(self.t)
        self.d1 = (F.log(self.s / self.k) + (self.r - self.q + 0.5 * self.v * self.v) * self.t) / self.root
        self.d2 = self.d1 - self.root
        self.dq, self.dr = F.exp(-self.q * self.T), F.exp(-self.r * self.T)

    def held(self, value: Column, *edges: tuple[Column, Column]) -> Column:
        """value in the region, else the last edge that applies."""
        out = _null()
        for condition, edge in edges:
            out = F.when(condition, edge).otherwise(out)
        return F.when(self.ok, value).otherwise(out)


def bscall(S, K, T, r, sigma, q=0.0) -> Column:
    m = Terms(S, K, T, r, sigma, q)
    return m.held(m.S * m.dq * normcdf(m.d1) - m.K * m.dr * normcdf(m.d2), ((m.T <= 0) | (m.sigma <= 0), F.greatest(m.S * m.dq - m.K * m.dr, F.lit(0.0))), (m.K <= 0, m.S * m.dq), (m.S <= 0, F.lit(0.0)))


def bsput(S, K, T, r, sigma, q=0.0) -> Column:
    m = Terms(S, K, T, r, sigma, q)
    return m.held(m.K * m.dr * normcdf(-m.d2) - m.S * m.dq * normcdf(-m.d1), ((m.T <= 0) | (m.sigma <= 0), F.greatest(m.K * m.dr - m.S * m.dq, F.lit(0.0))), (m.S <= 0, m.K * m.dr), (m.K <= 0, F.lit(0.0)))


def bscalldelta(S, K, T, r, sigma, q=0.0) -> Column:
    m = Terms(S, K, T, r, sigma, q)
    return m.held(m.dq * normcdf(m.d1), (m.sigma <= 0, F.when(m.S * m.dq > m.K * m.dr, m.dq).otherwise(0.0)), (m.T <= 0, F.when(m.S > m.K, 1.0).otherwise(0.0)), (m.K <= 0, m.dq), (m.S <= 0, F.lit(0.0)))


def bsputdelta(S, K, T, r, sigma, q=0.0) -> Column:
    m = Terms(S, K, T, r, sigma, q)
    return m.held(-m.dq * normcdf(-m.d1), (m.sigma <= 0, F.when(m.K * m.dr > m.S * m.dq, -m.dq).otherwise(0.0)), (m.T <= 0, F.when(m.K > m.S, -1.0).otherwise(0.0)), (m.S <= 0, -m.dq), (m.K <= 0, F.lit(0.0)))


def bscallrho(S, K, T, r, sigma, q=0.0) -> Column:
    m = Terms(S, K, T, r, sigma, q)
    return m.held(m.T * m.K * m.dr * normcdf(m.d2), (m.sigma <= 0, F.when(m.S * m.dq > m.K * m.dr, m.T * m.K * m.dr).otherwise(0.0)), ((m.T <= 0) | (m.K <= 0) | (m.S <= 0), F.lit(0.0)))


def bsputrho(S, K, T, r, sigma, q=0.0) -> Column:
    m = Terms(S, K, T, r, sigma, q)
    return m.held(-m.T * m.K * m.dr * normcdf(-m.d2), (m.sigma <= 0, F.when(m.K * m.dr > m.S * m.dq, -m.T * m.K * m.dr).otherwise(0.0)), (m.S <= 0, -m.T * m.K * m.dr), ((m.T <= 0) | (m.K <= 0), F.lit(0.0)))


def bscalltheta(S, K, T, r, sigma, q=0.0) -> Column:
    m = Terms(S, K, T, r, sigma, q)
    value = -m.S * m.dq * normpdf(m.d1) * m.v / (2.0 * F.sqrt(m.t)) - m.r * m.K * m.dr * normcdf(m.d2) + m.q * m.S * m.dq * normcdf(m.d1)
    return m.held(value, (m.sigma <= 0, F.when(m.S * m.dq > m.K * m.dr, m.q * m.S * m.dq - m.r * m.K * m.dr).otherwise(0.0)), (m.K <= 0, m.q * m.S * m.dq), ((m.T <= 0) | (m.S <= 0), F.lit(0.0)))


def bsputtheta(S, K, T, r, sigma, q=0.0) -> Column:
    m = Terms(S, K, T, r, sigma, q)
    value = -m.S * m.dq * normpdf(m.d1) * m.v / (2.0 * F.sqrt(m.t)) + m.r * m.K * m.dr * normcdf(-m.d2) - m.q * m.S * m.dq * normcdf(-m.d1)
    return m.held(value, (m.sigma <= 0, F.when(m.K * m.dr > m.S * m.dq, m.r * m.K * m.dr - m.q * m.S * m.dq).otherwise(0.0)), (m.S <= 0, m.r * m.K * m.dr), ((m.T <= 0) | (m.K <= 0), F.lit(0.0)))


def _smooth(m: Terms, value: Column) -> Column:
    """Greeks that vanish at the edges of the region."""
    return m.held(value, ((m.S >= 0) & (m.K >= 0), F.lit(0.0)))


def bsgamma(S, K, T, r, sigma, q=0.0) -> Column:
    m = Terms(S, K, T, r, sigma, q)
    return _smooth(m, _gamma(m))


def _gamma(m: Terms) -> Column:
    return m.dq * normpdf(m.d1) / (m.s * m.root)


def bsvega(S, K, T, r, sigma, q=0.0) -> Column:
    m = Terms(S, K, T, r, sigma, q)
    return _smooth(m, m.S * m.dq * normpdf(m.d1) * F.sqrt(m.t))


def bsvanna(S, K, T, r, sigma, q=0.0) -> Column:
    m = Terms(S, K, T, r, sigma, q)
    return _smooth(m, -m.dq * normpdf(m.d1) * m.d2 / m.v)


def bsvolga(S, K, T, r, sigma, q=0.0) -> Column:
    m = Terms(S, K, T, r, sigma, q)
    return _smooth(m, m.S * m.dq * normpdf(m.d1) * F.sqrt(m.t) * m.d1 * m.d2 / m.v)


def bsspeed(S, K, T, r, sigma, q=0.0) -> Column:
    m = Terms(S, K, T, r, sigma, q)
    return _smooth(m, -_gamma(m) / m.s * (m.d1 / m.root + 1.0))


def bszomma(S, K, T, r, sigma, q=0.0) -> Column:
    m = Terms(S, K, T, r, sigma, q)
    return _smooth(m, _gamma(m) * (m.d1 * m.d2 - 1.0) / m.v)


def _drift(m: Terms) -> Column:
    return (2.0 * (m.r - m.q) * m.t - m.d2 * m.root) / (2.0 * m.t * m.root)


def bscolor(S, K, T, r, sigma, q=0.0) -> Column:
    """Derivative of gamma by time to expiry."""
    m = Terms(S, K, T, r, sigma, q)
    return _smooth(m, -m.dq * normpdf(m.d1) / (2.0 * m.s * m.t * m.root) * (2.0 * m.q * m.t + 1.0 + (2.0 * (m.r - m.q) * m.t - m.d2 * m.root) / m.root * m.d1))


def bscallcharm(S, K, T, r, sigma, q=0.0) -> Column:
    """Change of delta per year of calendar time that passes."""
    m = Terms(S, K, T, r, sigma, q)
    return m.held(m.q * m.dq * normcdf(m.d1) - m.dq * normpdf(m.d1) * _drift(m), ((m.S >= 0) & (m.K >= 0), F.lit(0.0)), ((m.K <= 0) & (m.S > 0), -m.q * m.dq), (m.S <= 0, F.lit(0.0)))


def bsputcharm(S, K, T, r, sigma, q=0.0) -> Column:
    m = Terms(S, K, T, r, sigma, q)
    return m.held(-m.q * m.dq * normcdf(-m.d1) - m.dq * normpdf(m.d1) * _drift(m), ((m.S >= 0) & (m.K >= 0), F.lit(0.0)), (m.S <= 0, -m.q * m.dq))


def callpayoff(S, K) -> Column:
    return F.greatest(_c(S) - _c(K), F.lit(0.0))


def putpayoff(S, K) -> Column:
    return F.greatest(_c(K) - _c(S), F.lit(0.0))


def digitalprice(S, K, T, r, sigma, q=0.0, *, cash=1.0, is_call=True) -> Column:
    m = Terms(S, K, T, r, sigma, q)
    return F.when(m.ok, _c(cash) * m.dr * normcdf(m.d2 if is_call else -m.d2))


def gapprice(S, K_trigger, K_payoff, T, r, sigma, q=0.0, *, is_call=True) -> Column:
    m, pay = Terms(S, K_trigger, T, r, sigma, q), _c(K_payoff)
    call = m.S * m.dq * normcdf(m.d1) - pay * m.dr * normcdf(m.d2)
    put = pay * m.dr * normcdf(-m.d2) - m.S * m.dq * normcdf(-m.d1)
    return F.when(m.ok, call if is_call else put)


def chooserprice(S, K, T, t_choose, r, sigma, q=0.0) -> Column:
    r_, q_ = _c(r), _c(q)
    return bscall(S, K, T, r, sigma, q) + bsput(S, _c(K) * F.exp(-(r_ - q_) * (_c(T) - _c(t_choose))), t_choose, r, sigma, q)


def powerprice(S, K, T, r, sigma, q=0.0, *, n=2.0, is_call=True) -> Column:
    """Option on S**n against K."""
    if n == 0:
        raise ValueError("n must not be 0")
    m = Terms(S, K, T, r, sigma, q)
    forward = F.pow(m.s, F.lit(float(n))) * F.exp((n * (m.r - m.q) + 0.5 * n * (n - 1) * m.v * m.v) * m.t)
    width = abs(n) * m.root
    d1 = (F.log(forward / m.k) + 0.5 * width * width) / width
    d2 = d1 - width
    value = m.dr * (forward * normcdf(d1) - m.k * normcdf(d2)) if is_call else m.dr * (m.k * normcdf(-d2) - forward * normcdf(-d1))
    return F.when(m.ok, value)


def lookbackprice(S, S_extreme, T, r, sigma, q=0.0, *, is_call=True) -> Column:
    """Floating strike lookback; a carry of less than 1e-8 counts as 1e-8."""
    m = Terms(S, S_extreme, T, r, sigma, q)
    b = F.when(F.abs(m.r - m.q) < 1e-8, 1e-8).otherwise(m.r - m.q)
    a1 = (F.log(m.s / m.k) + (b + 0.5 * m.v * m.v) * m.t) / m.root
    a2 = a1 - m.root
    factor = m.v * m.v / (2.0 * b)
    power = F.pow(m.s / m.k, -2.0 * b / (m.v * m.v))
    carry, twist = F.exp((b - m.r) * m.t), 2.0 * b * F.sqrt(m.t) / m.v
    call = m.s * carry * normcdf(a1) - m.k * m.dr * normcdf(a2) + m.s * m.dr * factor * (power * normcdf(-a1 + twist) - F.exp(b * m.t) * normcdf(-a1))
    put = m.k * m.dr * normcdf(-a2) - m.s * carry * normcdf(-a1) + m.s * m.dr * factor * (-power * normcdf(a1 - twist) + F.exp(b * m.t) * normcdf(a1))
    return F.when(m.ok, call if is_call else put)


def moneynessbucket(S, K, T, r, q=0.0, edges=(-0.10, -0.03, 0.03, 0.10), labels=("deep_ITM", "ITM", "ATM", "OTM", "deep_OTM")) -> Column:
    """By log of strike over forward; an edge belongs to the bucket above it."""
    S, K, T, r, q = map(_c, (S, K, T, r, q))
    m = F.when((S > 0) & (K > 0), F.log(K / (S * F.exp((r - q) * T))))
    chain = reduce(lambda c, e: c.when(m < e[0], e[1]), zip(edges, labels), F.when(m.isNull(), F.lit(None).cast("string")))
    return chain.otherwise(labels[-1])


#: Fixed values of the solvers: bounds and least vega, and how many tolerances a settled price may be off.
LEAST_VOL, MOST_VOL, LEAST_VEGA, SETTLED = 1e-6, 10.0, 1e-8, 10

_erfc = np.frompyfunc(math.erfc, 1, 1)


def _values(S, K, T, r, q, sigma, is_call: bool):
    """Price and vega as arrays."""
    cdf = lambda x: 0.5 * _erfc(-x / math.sqrt(2.0)).astype(float)
    spread = sigma * np.sqrt(T)
    d1 = (np.log(S / K) + (r - q + sigma * sigma / 2) * T) / spread
    carried, discounted = S * np.exp(-q * T), K * np.exp(-r * T)
    sign = 1.0 if is_call else -1.0
    price = sign * (carried * cdf(sign * d1) - discounted * cdf(sign * (d1 - spread)))
    return price, carried * np.exp(-d1 * d1 / 2) / math.sqrt(2 * math.pi) * np.sqrt(T)


def _by_batch(solve):
    """A Column function over Arrow batches: of rows with all values and positive S, K and T; null elsewhere.

    Its arguments must be free of lambdas, as columns of data are.

    A search of many steps over one row is one long interpreted expression in
    the JVM; over arrays each step is a few vector operations, and only rows
    that haven't settled take part.
    """

    @F.pandas_udf("double")
    def run(price: pd.Series, S: pd.Series, K: pd.Series, T: pd.Series, r: pd.Series, q: pd.Series) -> pd.Series:
        terms = np.column_stack([x.to_numpy(float) for x in (price, S, K, T, r, q)])
        out = np.full(len(terms), np.nan)
        good = np.isfinite(terms).all(1) & (terms[:, 1:4] > 0).all(1)
        if good.any():
            with np.errstate(all="ignore"):
                out[good] = solve(*terms[good].T)
        return pd.Series(out).astype(object).where(np.isfinite(out), None)

    return run


def impvolbisection(price, S, K, T, r, is_call=True, q=0.0, steps=60, low=LEAST_VOL, high=MOST_VOL) -> Column:
    """Volatility at which the formula gives price, by halving [low, high]; null if it isn't bracketed."""

    def solve(price, S, K, T, r, q):
        value = lambda sigma: _values(S, K, T, r, q, sigma, is_call)[0]
        a, b = np.full(len(S), low), np.full(len(S), high)
        bracket = (value(a) <= price) & (value(b) >= price)
        for _ in range(steps):
            middle = (a + b) / 2
            below = value(middle) < price
            a, b = np.where(below, middle, a), np.where(below, b, middle)
        return np.where(bracket, (a + b) / 2, np.nan)

    return _by_batch(solve)(*map(_c, (price, S, K, T, r, q)))


def impvol(price, S, K, T, r, is_call=True, q=0.0, tol=1e-8, steps=100) -> Column:
    """Volatility by Newton's method from the spread of the money; null outside the no-arbitrage bounds or if it doesn't settle."""

    def solve(price, S, K, T, r, q):
        sigma = np.clip(np.sqrt(2 * np.abs(np.log(S / K) + r * T) / T), LEAST_VOL, MOST_VOL)
        left = np.arange(len(S))
        for _ in range(steps):
            value, slope = _values(S[left], K[left], T[left], r[left], q[left], sigma[left], is_call)
            gap = value - price[left]
            moves = (np.abs(gap) >= tol) & (slope > LEAST_VEGA)
            left, gap, slope = left[moves], gap[moves], slope[moves]
            if not len(left):
                break
            sigma[left] = np.clip(sigma[left] - gap / slope, LEAST_VOL, MOST_VOL)
        a, b = S * np.exp(-q * T), K * np.exp(-r * T)
        least, most = (np.maximum(a - b, 0), a) if is_call else (np.maximum(b - a, 0), b)
        settled = np.abs(_values(S, K, T, r, q, sigma, is_call)[0] - price) < SETTLED * tol
        return np.where((price >= least) & (price <= most) & settled, sigma, np.nan)

    return _by_batch(solve)(*map(_c, (price, S, K, T, r, q)))
