"""Distribution functions as Column expressions, with the same formulas as SQL text.

Spark and DuckDB both lack erf, so the normal distribution uses the published
rational approximation of erfc by Cody (relative error below 1e-15).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cody's coefficients for erf and erfc.
ERF_A = [3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1]
ERF_B = [2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03]
ERFC_C = [5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8]
ERFC_D = [1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03]
ERFC_P = [3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2]
ERFC_Q = [2.56852019228982242e00, 1.87295284992346047e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3]
# Acklam's coefficients for the inverse normal distribution.
PPF_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
PPF_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01]
PPF_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
PPF_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00]
PPF_LOW = 0.02425


def _horner(x, coefficients):
    total = coefficients[0]
    for c in coefficients[1:]:
        total = total * x + c
    return total


def _rational(x, top, bottom, lead=None):
    """(lead x^n + top...) / (x^n + bottom...), all by Horner's scheme."""
    return _horner(x, ([lead] if lead is not None else []) + top) / _horner(x, [1.0, *bottom])


def _erfc_parts(y, exp, sqrt_pi=math.sqrt(math.pi)):
    """erfc for y >= 0 on its three ranges."""
    z = y * y
    near = 1.0 - y * _horner(z, [ERF_A[4], *ERF_A[:4]]) / _horner(z, [1.0, *ERF_B])
    middle = exp(-1.0 * z) * _horner(y, [ERFC_C[8], *ERFC_C[:8]]) / _horner(y, [1.0, *ERFC_D])
    return near, middle


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it.

    Column trees have no names; without one, a formula is compiled anew for each
    use and the generated code outgrows what the JVM compiles.
    """
    return F.get(F.transform(F.array(value), body), 0)


def _normcdf(x: Column, y: Column) -> Column:
    near, middle = _erfc_parts(y, F.exp)
    t = 1.0 / F.greatest(y * y, F.lit(1e-300))
    far = F.exp(-1.0 * y * y) / F.greatest(y, F.lit(1e-300)) * (1 / math.sqrt(math.pi) - t * _horner(t, [ERFC_P[5], *ERFC_P[:5]]) / _horner(t, [1.0, *ERFC_Q]))
    tail = 0.5 * F.when(y <= 0.46875, near).when(y <= 4.0, middle).when(y < 27.0, far).otherwise(F.when(y.isNotNull(), F.lit(0.0)))
    return let(tail, lambda v: F.when(x >= 0, 1.0 - v).otherwise(v))


def normcdf(x: Column) -> Column:
    """Standard normal distribution; null and NaN give null."""
    return let(x.cast("double"), lambda v: let(F.when(~F.isnan(v), F.abs(v) / math.sqrt(2)), lambda y: _normcdf(v, y)))


def normpdf(x: Column) -> Column:
    return F.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)


def normppf(p: Column) -> Column:
    """Acklam's inverse: -inf at 0, inf at 1, null outside [0, 1]."""
    low = F.sqrt(-2.0 * F.log(F.when((p > 0) & (p < PPF_LOW), p).otherwise(0.01)))
    high = F.sqrt(-2.0 * F.log(1.0 - F.when((p < 1) & (p > 1 - PPF_LOW), p).otherwise(0.99)))
    q = p - 0.5
    middle = q * _horner(q * q, PPF_A) / _horner(q * q, [*PPF_B, 1.0])
    side = lambda u: _horner(u, PPF_C) / _horner(u, [*PPF_D, 1.0])
    return (
        F.when((p < 0) | (p > 1) | F.isnan(p), F.lit(None).cast("double"))
        .when(p == 0, F.lit(float("-inf"))).when(p == 1, F.lit(float("inf")))
        .when(p < PPF_LOW, side(low)).when(p <= 1 - PPF_LOW, middle).otherwise(-side(high))
    )


def lognormcdf(x: Column) -> Column:
    """log of the distribution, by an expansion where it underflows."""
    return let(x.cast("double"), _lognormcdf)


def _lognormcdf(x: Column) -> Column:
    y = F.least(x, F.lit(-37.0))
    z = 1.0 / (y * y)
    far = -0.5 * y * y - F.log(-1.0 * y) - 0.5 * math.log(2 * math.pi) + F.log1p(-1.0 * z + 3.0 * z * z - 15.0 * z * z * z)
    return F.when(x < -37, far).when(x >= 0, F.log1p(-1.0 * normcdf(-1.0 * x))).otherwise(F.log(F.greatest(normcdf(x), F.lit(1e-320))))


def lognormccdf(x: Column) -> Column:
    return lognormcdf(-1.0 * x)


def gpdpdf(x: Column, xi: Column, scale: Column) -> Column:
    z = x / scale
    inner = 1.0 + xi * z
    safe = F.when(inner > 0, inner).otherwise(1.0)
    general = F.pow(safe, -1.0 / F.when(F.abs(xi) < 1e-8, 1.0).otherwise(xi) - 1.0) / scale
    return F.when(scale <= 0, F.lit(None).cast("double")).when((x < 0) | (inner <= 0), 0.0).when(F.abs(xi) < 1e-8, F.exp(-1.0 * z) / scale).otherwise(general)


def gpdcdf(x: Column, xi: Column, scale: Column) -> Column:
    z = x / scale
    inner = 1.0 + xi * z
    safe = F.when(inner > 0, inner).otherwise(1.0)
    general = 1.0 - F.pow(safe, -1.0 / F.when(F.abs(xi) < 1e-8, 1.0).otherwise(xi))
    return F.when(scale <= 0, F.lit(None).cast("double")).when(x < 0, 0.0).when(F.abs(xi) < 1e-8, 1.0 - F.exp(-1.0 * z)).when(inner <= 0, 1.0).otherwise(general)


def gpdppf(p: Column, xi: Column, scale: Column) -> Column:
    shape = F.when(F.abs(xi) < 1e-8, 1.0).otherwise(xi)
    q = F.when((p > 0) & (p < 1), 1.0 - p).otherwise(0.5)
    inside = F.when(F.abs(xi) < 1e-8, -1.0 * scale * F.log(q)).otherwise(scale / shape * (F.pow(q, -1.0 * xi) - 1.0))
    return F.when((scale <= 0) | (p < 0) | (p > 1) | F.isnan(p), F.lit(None).cast("double")).when(p == 0, 0.0).when(p == 1, F.when(xi < 0, -1.0 * scale / shape).otherwise(F.lit(float("inf")))).otherwise(inside)


def gammaln(x: Column) -> Column:
    """log gamma for x > 0, by Stirling's series after shifting x above 10."""
    shift = F.aggregate(F.sequence(F.lit(0), F.lit(9)), F.lit(0.0), lambda a, k: a + F.log(x + k))
    y = x + 10.0
    z = 1.0 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    return F.when(x > 0, (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift)


def tpdf(x: Column, df: Column) -> Column:
    return F.exp(gammaln((df + 1.0) / 2.0) - gammaln(df / 2.0) - 0.5 * F.log(df * math.pi) - (df + 1.0) / 2.0 * F.log1p(x * x / df))


def logsumexp(values: Column) -> Column:
    """log of the sum of exponentials of an array."""
    return let(F.array_max(values), lambda top: F.when(F.abs(top) == float("inf"), top).otherwise(F.log(F.aggregate(values, F.lit(0.0), lambda a, v: a + F.exp(v - top))) + top))


def logsumexp_by(df: DataFrame, key: str, x: str, out: str = "v") -> DataFrame:
    """key and the log of the sum of exponentials of its rows: sums within steps of 32 first, so no group is held as a list."""
    step = F.when(F.abs(x) < float("inf"), F.floor(F.col(x) / 32) * 32.0).otherwise(0.0)
    sums = df.filter(F.col(x).isNotNull()).groupBy(key, step.alias("_k")).agg(F.sum(F.exp(F.col(x) - step)).alias("_s"))
    return sums.groupBy(key).agg(F.collect_list(F.when(F.col("_s") > 0, F.log("_s") + F.col("_k")).otherwise(float("-inf"))).alias("_a")).select(key, logsumexp(F.col("_a")).alias(out))


def sql_normcdf(x: str) -> str:
    """normcdf of a column as SQL text."""
    horner = lambda v, cs: _text(v, cs)
    y = f"(abs({x}) / sqrt(2::DOUBLE))"
    z = f"({y} * {y})"
    near = f"(1 - {y} * {horner(z, [ERF_A[4], *ERF_A[:4]])} / {horner(z, [1.0, *ERF_B])})"
    middle = f"(exp(-{z}) * {horner(y, [ERFC_C[8], *ERFC_C[:8]])} / {horner(y, [1.0, *ERFC_D])})"
    t = f"(1 / greatest({z}, 1e-300))"
    far = f"(exp(-{z}) / greatest({y}, 1e-300) * ({1 / math.sqrt(math.pi)!r}::DOUBLE - {t} * {horner(t, [ERFC_P[5], *ERFC_P[:5]])} / {horner(t, [1.0, *ERFC_Q])}))"
    tail = f"(0.5 * CASE WHEN {y} <= 0.46875 THEN {near} WHEN {y} <= 4 THEN {middle} WHEN {y} < 27 THEN {far} ELSE 0 END)"
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END)"


def _text(x: str, coefficients: list[float]) -> str:
    total = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        total = f"({total} * {x} + {c!r}::DOUBLE)"
    return total


def sql_normppf(p: str) -> str:
    side = lambda u: f"({_text(u, PPF_C)} / {_text(u, [*PPF_D, 1.0])})"
    q = f"({p} - 0.5::DOUBLE)"
    middle = f"({q} * {_text(f'({q} * {q})', PPF_A)} / {_text(f'({q} * {q})', [*PPF_B, 1.0])})"
    return f"(CASE WHEN {p} < {PPF_LOW} THEN {side(f'sqrt(-2 * ln({p}))')} WHEN {p} <= {1 - PPF_LOW} THEN {middle} ELSE -{side(f'sqrt(-2 * ln(1 - {p}))')} END)"


def chi2sf(x: Column, k: int) -> Column:
    """Upper tail of chi squared with a whole number k of degrees of freedom; 1 where x isn't positive.

    The finite sum of the upper incomplete gamma function at whole and half
    numbers.
    """
    if k < 1:
        raise ValueError(f"k must be 1 or more, not {k}")

    def tail(y: Column) -> Column:
        odd = k % 2
        terms = [F.pow(y, i + odd / 2) * (1 / math.gamma(i + 1 + odd / 2)) for i in range((k - odd) // 2)]
        total = F.exp(-1.0 * y) * sum(terms, F.lit(0.0))
        return 2.0 * normcdf(-1.0 * F.sqrt(2.0 * y)) + total if odd else total

    return let(x / 2.0, lambda y: F.when(y <= 0, 1.0).when(y > 0, tail(F.greatest(y, F.lit(0.0)))))


def sql_chi2sf(x: str, k: int) -> str:
    """chi2sf of a positive column as SQL text."""
    odd = k % 2
    terms = " + ".join(["0.0::DOUBLE", *[f"pow({x} / 2, {i + odd / 2}) * {1 / math.gamma(i + 1 + odd / 2)!r}::DOUBLE" for i in range((k - odd) // 2)]])
    total = f"exp(-{x} / 2) * ({terms})"
    return f"(2 * {sql_normcdf(f'(-sqrt({x}))')} + {total})" if odd else f"({total})"
