"""Numerical kernels over one ordered series (or a few) each, for grouped Arrow functions.

All take finite numpy arrays and return numbers or dicts of numbers; too few
values give NaN.  They are sequential or quadratic in the length of one series
and run one key per task, many keys at once.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

NAN = float("nan")
_N = NormalDist()


def clean(x) -> np.ndarray:
    x = np.asarray(x, float)
    return x[np.isfinite(x)]


def slope(x: np.ndarray, y: np.ndarray) -> float:
    x = x - x.mean()
    return float((x * (y - y.mean())).sum() / (x * x).sum()) if len(x) > 1 and (x * x).sum() > 0 else NAN


def kendall(x: np.ndarray, y: np.ndarray) -> float:
    """Tau-b; NaN without variation."""
    agree = moved_x = moved_y = 0.0
    step = max(1, 2_000_000 // max(1, len(x)))
    for k in range(0, len(x), step):  # blocks of rows: memory doesn't grow with the square
        a, b = np.sign(x[k : k + step, None] - x[None, :]), np.sign(y[k : k + step, None] - y[None, :])
        agree, moved_x, moved_y = agree + (a * b).sum(), moved_x + np.abs(a).sum(), moved_y + np.abs(b).sum()
    scale = math.sqrt(moved_x * moved_y)
    return float(agree / scale) if scale else NAN


# -- special functions -------------------------------------------------------------


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    h = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = 1 + top / (c if abs(c) > 1e-300 else 1e-300)
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def tcdf(x: float, df: float) -> float:
    if math.isnan(x):
        return NAN
    tail = 0.5 * betainc(df / 2, 0.5, df / (df + x * x))
    return 1 - tail if x > 0 else tail


def tppf(p: float, df: float) -> float:
    """Student's quantile by bisection."""
    if not 0 <= p <= 1:
        return NAN
    if p in (0, 1):
        return math.copysign(math.inf, p - 0.5)
    low, high = -1.0, 1.0
    while tcdf(low, df) > p:
        low *= 2
    while tcdf(high, df) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if tcdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def logtcdf(x: float, df: float) -> float:
    """log of the distribution; the tail's leading term where it underflows."""
    p = tcdf(x, df)
    if p > 0:
        return math.log(p)
    return (df / 2) * math.log(df / (df + x * x)) - math.log(df) - (math.lgamma(df / 2) + math.lgamma(0.5) - math.lgamma((df + 1) / 2))


def chi2sf(x: float, k: int) -> float:
    """Upper tail of chi squared by the series of the incomplete gamma function."""
    a, y = k / 2, x / 2
    if y <= 0:
        return 1.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16 and n < a + 10_000:
        n += 1
        term *= y / n
        total += term
    return max(0.0, 1 - total * math.exp(-y + a * math.log(y) - math.lgamma(a)))


# -- long memory -------------------------------------------------------------------


def _windows(low: int, high: int, n: int) -> np.ndarray:
    return np.unique(np.round(np.exp(np.linspace(np.log(low), np.log(high), n))).astype(int))


def hurstrs(r, min_w: int = 10, max_w: int | None = None, n_windows: int = 20) -> float:
    """Slope of the log mean rescaled range over log window."""
    r = clean(r)
    max_w = max_w or len(r) // 2
    if max_w <= min_w:
        return NAN
    w_, rs = [], []
    for w in _windows(min_w, max_w, n_windows):
        box = r[: len(r) // w * w].reshape(-1, w)
        d = np.cumsum(box - box.mean(1, keepdims=True), 1)
        s = box.std(1)
        ok = s > 0
        if ok.any():
            w_.append(w)
            rs.append(np.mean((d.max(1) - d.min(1))[ok] / s[ok]))
    return slope(np.log(w_), np.log(rs)) if len(w_) > 1 else NAN


def _residual_rms(profile: np.ndarray, w: int, order: int = 1) -> np.ndarray:
    box = profile[: len(profile) // w * w].reshape(-1, w).T
    basis = np.vander(np.arange(w) / w, order + 1)
    return np.sqrt(np.mean((box - basis @ np.linalg.lstsq(basis, box, rcond=None)[0]) ** 2, 0))


def dfa(x, min_w: int = 10, max_w: int | None = None, n_windows: int = 20) -> float:
    """Detrended fluctuation exponent of order 1: mean of the boxes' root mean squares."""
    x = clean(x)
    max_w = max_w or len(x) // 4
    if max_w <= min_w:
        return NAN
    profile = np.cumsum(x - x.mean())
    w = _windows(min_w, max_w, n_windows)
    return slope(np.log(w), np.log([_residual_rms(profile, k).mean() for k in w]))


def _moment_name(q: float) -> str:
    return f"h_{q}".replace("-", "m")


def mfdfa(x, q_values=(-4, -2, 0, 2, 4), scales=None, order: int = 1) -> dict[str, float]:
    """Generalised exponents by moment, boxes from both ends."""
    x = clean(x)
    if len(x) < 64:
        return {_moment_name(q): NAN for q in q_values}
    profile = np.cumsum(x - x.mean())
    scales = scales or _windows(16, len(x) // 4, 12)
    f = [np.concatenate([_residual_rms(profile, s, order), _residual_rms(profile[::-1], s, order)]) for s in scales]
    moment = lambda v, q: np.exp(0.5 * np.mean(np.log(v * v))) if q == 0 else np.mean((v * v) ** (q / 2)) ** (1 / q)
    return {_moment_name(q): slope(np.log(scales), np.log([moment(v, q) for v in f])) for q in q_values}


def higuchihurst(x, k_max: int = 16) -> float:
    """2 less Higuchi's fractal dimension."""
    x = clean(x)
    n = len(x)
    if n < 2 * k_max:
        return NAN
    length = []
    for k in range(1, k_max + 1):
        parts = [np.abs(np.diff(x[m::k])).sum() * (n - 1) / (len(x[m::k]) - 1) / k / k for m in range(k) if len(x[m::k]) > 1]
        length.append(np.mean(parts))
    return 2 - slope(-np.log(np.arange(1, k_max + 1)), np.log(length))


def localwhittle(x, m: int | None = None) -> float:
    """Robinson's estimate d + 1/2 by a grid and golden section."""
    x = clean(x)
    n = len(x)
    m = m or int(n**0.7)
    if n < 32 or m < 4:
        return NAN
    lam = 2 * np.pi * np.arange(1, m + 1) / n
    power = np.abs(np.fft.rfft(x - x.mean())[1 : m + 1]) ** 2 / (2 * np.pi * n)
    goal = lambda d: np.log(np.mean(lam ** (2 * d) * power)) - 2 * d * np.mean(np.log(lam))
    grid = np.linspace(-0.49, 0.99, 60)
    k = int(np.argmin([goal(d) for d in grid]))
    a, b = grid[max(0, k - 1)], grid[min(59, k + 1)]
    g = (math.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if goal(c) < goal(d) else (c, b)
    return (a + b) / 2 + 0.5


def wavelethurst(x, scale_lo: int = 2, scale_hi: int = 7) -> float:
    """From the slope of the log variance of Haar details over scale."""
    x = clean(x)
    js, vs, level = [], [], x
    for j in range(1, scale_hi + 1):
        level = level[: len(level) // 2 * 2]
        if len(level) < 8:
            break
        detail, level = (level[0::2] - level[1::2]) / math.sqrt(2), (level[0::2] + level[1::2]) / math.sqrt(2)
        if j >= scale_lo:
            js.append(j)
            vs.append(math.log2(np.mean(detail**2)))
    return (slope(np.array(js), np.array(vs)) + 1) / 2 if len(js) > 1 else NAN


def spectralentropy(x, detrend: bool = True) -> float:
    """Entropy of the power spectrum without its constant, over its most."""
    x = clean(x)
    if len(x) < 4:
        return NAN
    power = np.abs(np.fft.rfft(x - x.mean() if detrend else x)[1:]) ** 2
    p = power / power.sum() if power.sum() > 0 else power
    return float(-(p[p > 0] * np.log(p[p > 0])).sum() / math.log(len(p)))


# -- tests -------------------------------------------------------------------------


def bdstest(x, m: int = 2, epsilon: float | None = None) -> dict[str, float]:
    """Brock, Dechert and Scheinkman's z, with C1(2 eps) for K."""
    x = clean(x)
    n = len(x)
    if n < 50:
        return {"z": NAN, "p": NAN}
    eps = epsilon or 0.7 * x.std(ddof=1)
    near = np.abs(x[:, None] - x[None, :]) < eps
    joint = near[: n - m + 1, : n - m + 1].copy()
    for k in range(1, m):
        joint &= near[k : n - m + 1 + k, k : n - m + 1 + k]
    share = lambda a: (a.sum() - len(a)) / (len(a) * (len(a) - 1))
    c, cm = share(near), share(joint)
    k = share(np.abs(x[:, None] - x[None, :]) < 2 * eps)
    var = 4 * (k**m + 2 * sum(k ** (m - j) * c ** (2 * j) for j in range(1, m)) + (m - 1) ** 2 * c ** (2 * m) - m * m * k * c ** (2 * m - 2))
    z = math.sqrt(n) * (cm - c**m) / math.sqrt(var) if var > 0 else NAN
    return {"z": float(z), "p": 2 * (1 - _N.cdf(abs(z))) if not math.isnan(z) else NAN}


def _ols(y: np.ndarray, X: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b, *_ = np.linalg.lstsq(X, y, rcond=None)
    e = y - X @ b
    cov = np.linalg.pinv(X.T @ X) * (e @ e) / max(1, len(y) - X.shape[1])
    return b, np.sqrt(np.diag(cov)), e


def _lagged(x: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    d = np.diff(x)
    cols = [x[p:-1], *[d[p - k : len(d) - k] for k in range(1, p + 1)], np.ones(len(d) - p)]
    return d[p:], np.column_stack(cols)


def adftest(x, max_lag: int | None = None) -> dict[str, float]:
    """Augmented Dickey-Fuller t with a constant; the lag of least AIC over one sample."""
    x = clean(x)
    n = len(x)
    if n < 20:
        return {"stat": NAN, "lag": NAN}
    most = max_lag if max_lag is not None else min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)
    y0, X0 = _lagged(x, most)

    def aic(p: int) -> float:
        X = np.column_stack([X0[:, : 1 + p], X0[:, -1]])
        e = _ols(y0, X)[2]
        return len(y0) * math.log(e @ e / len(y0)) + 2 * X.shape[1]

    p = min(range(most + 1), key=aic)
    y, X = _lagged(x, p)
    b, se, _ = _ols(y, X)
    return {"stat": float(b[0] / se[0]), "lag": float(p)}


def kpsstest(x) -> dict[str, float]:
    """Level stationarity with Bartlett weights and the automatic bandwidth of Hobijn et al."""
    x = clean(x)
    n = len(x)
    if n < 20:
        return {"stat": NAN, "lags": NAN}
    e = x - x.mean()
    cov = int(n ** (2 / 9))
    s0, s1 = e @ e / n, 0.0
    for i in range(1, cov + 1):
        prod = e[i:] @ e[:-i] / (n / 2)
        s0, s1 = s0 + prod, s1 + i * prod
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    var = e @ e + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))
    return {"stat": float((np.cumsum(e) ** 2).sum() / n**2 / (var / n)), "lags": float(lags)}


def phillipsperrontest(x) -> dict[str, float]:
    """Z-tau with a constant."""
    x = clean(x)
    n = len(x) - 1
    if n < 20:
        return {"stat": NAN}
    X = np.column_stack([x[:-1], np.ones(n)])
    b, se, e = _ols(x[1:], X)
    lags = int(math.ceil(12 * (n / 100) ** 0.25))
    g0 = e @ e / n
    lam = g0 + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) / n for k in range(1, lags + 1))
    s2 = e @ e / (n - 2)
    t = (b[0] - 1) / se[0]
    return {"stat": float(math.sqrt(g0 / lam) * t - 0.5 * (lam - g0) / math.sqrt(lam) * n * se[0] / math.sqrt(s2))}


def shapirowilk(x) -> dict[str, float]:
    """W by Royston's polynomials (AS R94); at most 5,000 evenly spaced values."""
    x = np.sort(clean(x))
    if len(x) > 5000:
        x = x[np.linspace(0, len(x) - 1, 5000).astype(int)]
    n = len(x)
    if n < 12 or x[0] == x[-1]:
        return {"w": NAN, "p": NAN}
    m = np.array([_N.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u = 1 / math.sqrt(n)
    c = m / math.sqrt(m @ m)
    # Royston's polynomials.
    last = np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, c[-1]], u)
    second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, c[-2]], u)
    phi = (m @ m - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
    a = m / math.sqrt(phi)
    a[-1], a[-2], a[0], a[1] = last, second, -last, -second
    w = float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum())
    log = math.log(n)
    mu = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], log)
    sigma = math.exp(np.polyval([0.0030302, -0.082676, -0.4803], log))
    return {"w": w, "p": 1 - _N.cdf((math.log(1 - w) - mu) / sigma)}


def distancecorr(x, y, most: int = 2000) -> float:
    """Distance correlation of the last ``most`` pairs."""
    ok = np.isfinite(x) & np.isfinite(y)
    x, y = np.asarray(x)[ok][-most:], np.asarray(y)[ok][-most:]
    if len(x) < 2:
        return NAN

    def centred(v):
        d = np.abs(v[:, None] - v[None, :])
        return d - d.mean(0) - d.mean(1)[:, None] + d.mean()

    a, b = centred(x), centred(y)
    scale = math.sqrt((a * a).mean() * (b * b).mean())
    return float(math.sqrt(max(0.0, (a * b).mean()) / scale)) if scale else NAN


def andrewsse(y, x) -> dict[str, float]:
    """y on x and a constant with quadratic-spectral weights and Andrews' AR(1) bandwidth."""
    ok = np.isfinite(y) & np.isfinite(x)
    y, X = np.asarray(y)[ok], np.column_stack([np.ones(ok.sum()), np.asarray(x)[ok]])
    n = len(y)
    b, _, e = _ols(y, X)
    v = X * e[:, None]
    top = bottom = 0.0
    for k in range(2):
        r = float(v[1:, k] @ v[:-1, k] / (v[:-1, k] @ v[:-1, k]))
        s = float(np.mean((v[1:, k] - r * v[:-1, k]) ** 2))
        top += 4 * r * r * s * s / (1 - r) ** 8
        bottom += s * s / (1 - r) ** 4
    band = 1.3221 * (top / bottom * n) ** 0.2
    S = v.T @ v
    for k in range(1, n):
        z = 6 * math.pi * k / (5 * band)
        w = 25 / (12 * math.pi**2 * (k / band) ** 2) * (math.sin(z) / z - math.cos(z))
        if k > 20 * band:
            break
        g = v[k:].T @ v[:-k]
        S += w * (g + g.T)
    inv = np.linalg.inv(X.T @ X)
    se = np.sqrt(np.maximum(np.diag(inv @ S @ inv), 0))
    return {"alpha": float(b[0]), "beta": float(b[1]), "se_alpha": float(se[0]), "se_beta": float(se[1]), "bandwidth": float(band)}


# -- nonlinear dynamics --------------------------------------------------------------


def embed(x: np.ndarray, m: int, tau: int = 1) -> np.ndarray:
    n = len(x) - (m - 1) * tau
    return np.column_stack([x[k * tau : k * tau + n] for k in range(m)]) if n > 0 else np.zeros((0, m))


def _far(p: np.ndarray, chebyshev: bool = True, q: np.ndarray | None = None) -> np.ndarray:
    """Distances of every row of p to every row of q (or p)."""
    q = p if q is None else q
    total = np.zeros((len(p), len(q)))
    for k in range(p.shape[1]):
        gap = np.abs(p[:, k, None] - q[None, :, k])
        total = np.maximum(total, gap, out=total) if chebyshev else total + gap * gap
    return total if chebyshev else np.sqrt(total)


def _far_blocks(p: np.ndarray, chebyshev: bool = True, cells: int = 4_000_000):
    """_far() in blocks of rows that hold some cells: (first row, distances).  Memory doesn't grow with the square."""
    step = max(1, cells // max(1, len(p)))
    for a in range(0, len(p), step):
        yield a, _far(p[a : a + step], chebyshev, p)


def permutationentropy(x, m: int = 3, tau: int = 1) -> float:
    e = embed(clean(x), m, tau)
    if not len(e):
        return NAN
    _, c = np.unique(np.argsort(e, 1, kind="stable"), axis=0, return_counts=True)
    p = c / c.sum()
    return float(-(p * np.log(p)).sum() / math.log(math.factorial(m)))


def sampleentropy(x, m: int = 2, r: float | None = None) -> float:
    x = clean(x)
    r = r if r is not None else 0.2 * x.std(ddof=1)
    count = lambda k: (sum(np.count_nonzero(d <= r) for _, d in _far_blocks(embed(x, k))) - len(x) + k - 1) / 2
    a, b = count(m + 1), count(m)
    return float(-math.log(a / b)) if a > 0 and b > 0 else NAN


def approximateentropy(x, m: int = 2, r: float | None = None) -> float:
    x = clean(x)
    r = r if r is not None else 0.2 * x.std(ddof=1)
    phi = lambda k: float(np.mean(np.log(np.concatenate([(d <= r).mean(1) for _, d in _far_blocks(embed(x, k))]))))
    return phi(m) - phi(m + 1)


def dispersionentropy(x, m: int = 3, tau: int = 1, c: int = 6) -> float:
    x = clean(x)
    if x.std() == 0:
        return NAN
    z = np.array([_N.cdf(v) for v in (x - x.mean()) / x.std()])
    k = np.clip(np.round(c * z + 0.5), 1, c).astype(int)
    _, n = np.unique(embed(k, m, tau), axis=0, return_counts=True)
    p = n / n.sum()
    return float(-(p * np.log(p)).sum() / math.log(c**m))


def transferentropy(x, y, lag: int = 1, bins: int = 6) -> float:
    """Bits of y's next value that x's past adds to y's past, over quantile bins."""
    x, y = np.asarray(x), np.asarray(y)
    b = lambda v: np.digitize(v, np.quantile(v, np.arange(1, bins) / bins))
    x, y = b(x), b(y)
    now, past, other = y[lag:], y[:-lag], x[:-lag]
    h = lambda *c: (lambda p: -(p * np.log2(p)).sum())(np.unique(np.column_stack(c), axis=0, return_counts=True)[1] / len(now))
    return float(h(now, past) + h(past, other) - h(past) - h(now, past, other))


def mutualinfo(x, lag: int = 1, bins: int = 32) -> float:
    x = clean(x)
    joint, *_ = np.histogram2d(x[:-lag], x[lag:], bins)
    p = joint / joint.sum()
    a, b = p.sum(1, keepdims=True), p.sum(0, keepdims=True)
    ok = p > 0
    return float((p[ok] * np.log(p[ok] / (a @ b)[ok])).sum())


def falsenearest(x, tau: int = 1, max_dim: int = 10, r_tol: float = 15.0, threshold: float = 0.05) -> dict[str, float]:
    """Share of false neighbours by dimension and the first dimension at or below the threshold."""
    x = clean(x)
    shares = []
    for m in range(1, max_dim + 1):
        n = len(x) - m * tau
        if n < 10:
            break
        found = []
        for a, d in _far_blocks(embed(x, m, tau)[:n], False):
            d[np.arange(len(d)), a + np.arange(len(d))] = np.inf
            at = d.argmin(1)
            found.append((at, d[np.arange(len(d)), at]))
        j, near = (np.concatenate(c) for c in zip(*found, strict=True))
        ok = near > 0
        shares.append(float(np.mean(np.abs(x[m * tau :][:n] - x[m * tau :][j])[ok] / near[ok] > r_tol)) if ok.any() else NAN)
    first = next((k + 1 for k, s in enumerate(shares) if s <= threshold), len(shares))
    return {"dimension": float(first), "share_1": shares[0] if shares else NAN, "share_last": shares[-1] if shares else NAN}


def corrdim(x, tau: int = 1, m: int = 5, n_r: int = 20, low: float = 0.05, high: float = 0.5) -> float:
    """Grassberger and Procaccia's slope on the middle 60 per cent of radii."""
    x = clean(x)
    e = embed(x, m, tau)
    r = np.exp(np.linspace(math.log(low * x.std()), math.log(high * x.std()), n_r))
    below = np.zeros(n_r)
    for _, d in _far_blocks(e):  # every pair twice, and each row with itself
        below += [np.count_nonzero(d < k) for k in r]
    c = (below - len(e)) / max(1, len(e) * (len(e) - 1))
    k = slice(int(0.2 * n_r), int(0.8 * n_r))
    ok = c[k] > 0
    return slope(np.log(r[k][ok]), np.log(c[k][ok]))


def lyapunov(x, tau: int = 1, m: int = 5, max_t: int = 20, k_neighbors: int = 1, fit_end: int = 10) -> float:
    """Rosenstein's largest exponent: mean log divergence from the k nearest neighbours outside m * tau steps."""
    x = clean(x)
    e = embed(x, m, tau)
    n = len(e) - max_t
    if n < 50:
        return NAN
    near = []
    for a, d in _far_blocks(e[:n], False):
        d[np.abs(a + np.arange(len(d))[:, None] - np.arange(n)[None, :]) <= m * tau] = np.inf
        near.append(np.argpartition(d, k_neighbors - 1, 1)[:, :k_neighbors])
    near = np.concatenate(near)
    curve = []
    for t in range(max_t):
        gap = np.sqrt(((e[np.arange(n) + t][:, None, :] - e[near + t]) ** 2).sum(2))
        curve.append(np.mean(np.log(gap[gap > 0])))
    return slope(np.arange(1.0, fit_end + 1), np.array(curve[1 : fit_end + 1]))


#: Fixed value: recurrence plots are of the last 2,000 values, for they need all distances at once.
RECURRENCE = 2_000


def _lines(a: np.ndarray, l_min: int) -> np.ndarray:
    """Lengths of runs of ones in the rows of a boolean matrix."""
    padded = np.zeros((a.shape[0], a.shape[1] + 2), np.int8)
    padded[:, 1:-1] = a
    d = np.diff(padded, axis=1)
    return np.nonzero(d == -1)[1] - np.nonzero(d == 1)[1] if (d == 1).any() else np.zeros(0, int)


def _recurrence(r: np.ndarray, l_min: int, both: bool) -> dict[str, float]:
    n, k = r.shape
    diagonals = [np.diagonal(r, o) for o in range(1 if not both else -(n - 1), k)]
    runs = np.concatenate([_lines(d[None, :], l_min) for d in diagonals if len(d)] or [np.zeros(0, int)])
    vertical = _lines(r.T, l_min)
    long_, tall = runs[runs >= l_min], vertical[vertical >= l_min]
    p = np.unique(long_, return_counts=True)[1] / max(1, len(long_))
    return {"recurrence_rate": float(r.mean()), "determinism": float(long_.sum() / max(1, runs.sum())), "laminarity": float(tall.sum() / max(1, vertical.sum())), "longest": float(runs.max() if len(runs) else 0), "entropy": float(-(p * np.log(p)).sum() if len(p) else 0.0)}


def rqa(x, tau: int = 1, m: int = 5, rate: float = 0.1, l_min: int = 2) -> dict[str, float]:
    d = _far(embed(clean(x)[-RECURRENCE:], m, tau))
    off = d[~np.eye(len(d), dtype=bool)]
    r = d <= np.quantile(off, rate)
    np.fill_diagonal(r, False)
    return _recurrence(r, l_min, False)


def crossrecurrence(x, y, tau: int = 1, m: int = 5, rate: float = 0.1, l_min: int = 2) -> dict[str, float]:
    z = lambda v: (v - v.mean()) / (v.std() or 1)
    a, b = embed(z(np.asarray(x)[-RECURRENCE:]), m, tau), embed(z(np.asarray(y)[-RECURRENCE:]), m, tau)
    d = _far(a, True, b)
    return _recurrence(d <= np.quantile(d, rate), l_min, True)


def jointrecurrence(x, y, tau: int = 1, m: int = 5, rate: float = 0.1, l_min: int = 2) -> dict[str, float]:
    both = []
    for v in (x, y):
        d = _far(embed(np.asarray(v)[-RECURRENCE:], m, tau))
        both.append(d <= np.quantile(d[~np.eye(len(d), dtype=bool)], rate))
    r = both[0] & both[1]
    np.fill_diagonal(r, False)
    return _recurrence(r, l_min, False)


def ccm(x, y, tau: int = 1, m: int = 5, lib_sizes=(50, 100, 200, 400), seed: int = 0) -> dict[str, float]:
    """Skill of y's shadow manifold at x, for growing libraries."""
    x, y = np.asarray(x), np.asarray(y)
    e, goal = embed(y, m, tau), x[(m - 1) * tau :]
    rng, out = np.random.default_rng(seed), {}
    for size in lib_sizes:
        lib = rng.choice(len(e), min(size, len(e)), replace=False)
        d = _far(e, False, e[lib])
        d[lib, np.arange(len(lib))] = np.inf
        near = np.argsort(d, 1)[:, : m + 1]
        dist = np.take_along_axis(d, near, 1)
        w = np.exp(-dist / np.maximum(dist[:, :1], 1e-12))
        guess = (w * goal[lib[near]]).sum(1) / w.sum(1)
        out[f"rho_{size}"] = float(np.corrcoef(guess, goal)[0, 1])
    return out


# -- hidden Markov models --------------------------------------------------------------


def hmm_log(logb: np.ndarray, pi, A) -> tuple[np.ndarray, np.ndarray, float]:
    """Log forward and backward tables and the log likelihood of emissions logb (T x N)."""
    with np.errstate(divide="ignore"):
        lp, la = np.log(np.asarray(pi, float)), np.log(np.asarray(A, float))
    T, N = logb.shape
    alpha, beta = np.empty((T, N)), np.zeros((T, N))
    alpha[0] = lp + logb[0]
    for t in range(1, T):
        alpha[t] = np.logaddexp.reduce(alpha[t - 1][:, None] + la, 0) + logb[t]
    for t in range(T - 2, -1, -1):
        beta[t] = np.logaddexp.reduce(la + (logb[t + 1] + beta[t + 1])[None, :], 1)
    return alpha, beta, float(np.logaddexp.reduce(alpha[-1]))


def hmm_viterbi(logb: np.ndarray, pi, A) -> tuple[np.ndarray, float]:
    """Likeliest path, the first of equals, and its log probability."""
    with np.errstate(divide="ignore"):
        lp, la = np.log(np.asarray(pi, float)), np.log(np.asarray(A, float))
    T, N = logb.shape
    v, back = lp + logb[0], np.zeros((T, N), int)
    for t in range(1, T):
        s = v[:, None] + la
        back[t], v = s.argmax(0), s.max(0) + logb[t]
    path = [int(v.argmax())]
    for t in range(T - 1, 0, -1):
        path.append(int(back[t][path[-1]]))
    return np.array(path[::-1]), float(v.max())


def gaussian_log(x, mu, sigma) -> np.ndarray:
    x, mu, sigma = np.asarray(x, float)[:, None], np.asarray(mu, float)[None, :], np.asarray(sigma, float)[None, :]
    return -0.5 * ((x - mu) / sigma) ** 2 - np.log(sigma) - 0.5 * math.log(2 * math.pi)


def hmm_posterior(logb, pi, A) -> tuple[np.ndarray, np.ndarray, float]:
    """State chances by time, expected transitions and the log likelihood."""
    alpha, beta, like = hmm_log(logb, pi, A)
    gamma = np.exp(alpha + beta - like)
    with np.errstate(divide="ignore"):
        la = np.log(np.asarray(A, float))
    xi = np.exp(alpha[:-1, :, None] + la[None] + (logb[1:] + beta[1:])[:, None, :] - like)
    return gamma / gamma.sum(1, keepdims=True), xi.sum(0), like


def baumwelch(obs, n_states: int = 2, n_symbols: int | None = None, max_iter: int = 50, tol: float = 1e-4, seed: int = 0) -> dict:
    """Expectation maximisation: Gaussian emissions, or symbols if n_symbols is given."""
    obs = np.asarray(obs)
    rng = np.random.default_rng(seed)
    pi, A = np.full(n_states, 1 / n_states), rng.dirichlet(np.ones(n_states) * 2, n_states) * 0.5 + np.eye(n_states) * 0.5
    if n_symbols:
        B = rng.dirichlet(np.ones(n_symbols), n_states)
    else:
        mu, sigma = np.quantile(obs, (np.arange(n_states) + 0.5) / n_states), np.full(n_states, obs.std() + 1e-9)
    before, history = -np.inf, []
    for _ in range(max_iter):
        logb = np.log(np.maximum(B[:, obs.astype(int)].T, 1e-300)) if n_symbols else gaussian_log(obs, mu, sigma)
        gamma, xi, like = hmm_posterior(logb, pi, A)
        history.append(like)
        pi, A = gamma[0], xi / np.maximum(xi.sum(1, keepdims=True), 1e-300)
        weight = np.maximum(gamma.sum(0), 1e-300)
        if n_symbols:
            B = np.stack([np.bincount(obs.astype(int), gamma[:, k], n_symbols) for k in range(n_states)]) / weight[:, None]
        else:
            mu = gamma.T @ obs / weight
            sigma = np.maximum(np.sqrt((gamma * (obs[:, None] - mu) ** 2).sum(0) / weight), 1e-3 * (obs.std() + 1e-12))
        if like - before < tol:
            break
        before = like
    return {"log_likelihood": like, "iterations": len(history), "history": history, "pi": pi, "A": A, **({"B": B} if n_symbols else {"mu": mu, "sigma": sigma})}


# -- decompositions ---------------------------------------------------------------------


def spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural cubic spline."""
    n = len(x)
    if n < 3:
        return np.interp(at, x, y)
    h = np.diff(x)
    M = np.zeros((n, n))
    M[0, 0] = M[-1, -1] = 1
    k = np.arange(1, n - 1)
    M[k, k - 1], M[k, k], M[k, k + 1] = h[:-1], 2 * (h[:-1] + h[1:]), h[1:]
    rhs = np.zeros(n)
    rhs[1:-1] = 6 * (np.diff(y[1:]) / h[1:] - np.diff(y[:-1]) / h[:-1])
    m = np.linalg.solve(M, rhs)
    i = np.clip(np.searchsorted(x, at) - 1, 0, n - 2)
    a, b = (x[i + 1] - at) / h[i], (at - x[i]) / h[i]
    return a * y[i] + b * y[i + 1] + ((a**3 - a) * m[i] + (b**3 - b) * m[i + 1]) * h[i] ** 2 / 6


def emd(x, max_imfs: int = 8, sifting_iters: int = 10) -> np.ndarray:
    """Intrinsic modes and the rest, as rows that sum to x."""
    x = np.asarray(x, float)
    t, rest, found = np.arange(len(x)), x.copy(), []
    for _ in range(max_imfs):
        h = rest.copy()
        for _ in range(sifting_iters):
            d = np.diff(h)
            top, low = np.flatnonzero((d[:-1] > 0) & (d[1:] <= 0)) + 1, np.flatnonzero((d[:-1] < 0) & (d[1:] >= 0)) + 1
            if len(top) < 3 or len(low) < 3:
                break
            ends = lambda k: np.concatenate([[0], k, [len(x) - 1]])
            h = h - (spline(ends(top), h[ends(top)], t) + spline(ends(low), h[ends(low)], t)) / 2
        else:
            found.append(h)
            rest = rest - h
            continue
        break
    return np.vstack([*found, rest])


def whitening(X: np.ndarray, method: str = "zca", ridge: float = 1e-6) -> np.ndarray:
    X = X - X.mean(0)
    value, vector = np.linalg.eigh(X.T @ X / len(X))
    scale = vector / np.sqrt(np.maximum(value, ridge))
    return X @ (scale @ vector.T if method == "zca" else scale)


def ica(X: np.ndarray, n_components: int | None = None, max_iter: int = 300, tol: float = 1e-4, seed: int = 0) -> np.ndarray:
    """Parallel FastICA with the log cosh contrast."""
    Z = whitening(X, "pca")[:, ::-1][:, : n_components or X.shape[1]]
    k = Z.shape[1]
    half = lambda W: (lambda u, s, v: u @ v)(*np.linalg.svd(W))
    W = half(np.random.default_rng(seed).standard_normal((k, k)))
    for _ in range(max_iter):
        g = np.tanh(Z @ W.T)
        new = half(g.T @ Z / len(Z) - (1 - g * g).mean(0)[:, None] * W)
        done = np.max(np.abs(np.abs((new * W).sum(1)) - 1)) < tol
        W = new
        if done:
            break
    return Z @ W.T


#: Bytes of a kernel matrix that are held; larger ones are made anew in blocks for each product.
KERNEL_BYTES = 300_000_000


def kernelpca(X: np.ndarray, n_components: int = 3, gamma: float | None = None, dense: int = 600) -> np.ndarray:
    """Components by a Gaussian kernel of all columns, centred.

    Equal rows are one row with a weight.  Over ``dense`` different rows the
    leading eigenvectors are found by a block Krylov method, to a residual of
    1e-10 of the largest eigenvalue, without the others.
    """
    rows, where, weight = np.unique(X, axis=0, return_inverse=True, return_counts=True)
    where, root, n = where.reshape(-1), np.sqrt(weight), len(X)
    gamma = gamma or 1 / X.shape[1]
    square = (rows * rows).sum(1)
    step = max(1, 4_000_000 // len(rows))

    def block(at: int) -> np.ndarray:
        far = rows[at : at + step] @ rows.T
        far *= -2
        far += square[at : at + step, None]
        far += square
        np.maximum(far, 0, out=far)
        far *= -gamma
        return np.exp(far, out=far)

    held = np.concatenate([block(at) for at in range(0, len(rows), step)]) if 8 * len(rows) ** 2 <= KERNEL_BYTES else None

    def times(v: np.ndarray) -> np.ndarray:
        """The weighted, centred kernel matrix times v."""
        v = root[:, None] * v
        v -= weight[:, None] * (v.sum(0) / n)
        out = held @ v if held is not None else np.concatenate([block(at) @ v for at in range(0, len(rows), step)])
        out -= weight @ out / n
        return root[:, None] * out

    if len(rows) <= dense:
        value, vector = np.linalg.eigh(times(np.eye(len(rows))))
        top = np.argsort(-value)[:n_components]
        value, vector = value[top], vector[:, top]
    else:
        value, vector = _leading(times, len(rows), n_components)
    return (vector / root[:, None])[where] * np.sqrt(np.maximum(value, 0))


def _leading(times, n: int, k: int, width: int = 16, most: int = 320, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and their vectors of a symmetric n x n matrix, given as a product with columns."""
    width = max(width, 2 * k)
    new = np.linalg.qr(np.random.default_rng(0).standard_normal((n, width)))[0]
    basis, image = np.zeros((n, 0)), np.zeros((n, 0))
    while True:
        basis, image = np.column_stack([basis, new]), np.column_stack([image, times(new)])
        small = basis.T @ image
        value, turn = np.linalg.eigh((small + small.T) / 2)
        value, turn = value[::-1], turn[:, ::-1]
        rest = image @ turn[:, :width] - basis @ turn[:, :width] * value[:width]
        if basis.shape[1] + width > n or (np.linalg.norm(rest[:, :k], axis=0) <= tol * abs(value[0])).all():
            return value[:k], basis @ turn[:, :k]
        if basis.shape[1] + width > most:
            basis, image = basis @ turn[:, : most // 4], image @ turn[:, : most // 4]
        for _ in range(2):
            rest = rest - basis @ (basis.T @ rest)
            rest = np.linalg.qr(rest)[0]
        new = rest


# -- portfolios on a covariance matrix ----------------------------------------------------


def riskparity(cov: np.ndarray, rounds: int = 500, tol: float = 1e-10) -> np.ndarray:
    """Equal risk contributions by cyclical coordinate descent."""
    n = len(cov)
    w, b = np.ones(n) / np.sqrt(np.diag(cov)), 1 / n
    for _ in range(rounds):
        old = w.copy()
        for i in range(n):
            a = cov[i] @ w - cov[i, i] * w[i]
            w[i] = (-a + math.sqrt(a * a + 4 * cov[i, i] * b)) / (2 * cov[i, i])
        if np.abs(w - old).max() < tol:
            break
    return w / w.sum()


def hrp(cov: np.ndarray) -> np.ndarray:
    """Hierarchical risk parity: single linkage on correlation distance, recursive bisection by inverse variance."""
    sd = np.sqrt(np.diag(cov))
    dist = np.sqrt(np.maximum(0, (1 - cov / np.outer(sd, sd)) / 2))
    dist = np.sqrt(((dist[:, None, :] - dist[None, :, :]) ** 2).sum(2))
    groups = {i: [i] for i in range(len(cov))}
    while len(groups) > 1:
        keys = list(groups)
        a, b = min(((p, q) for i, p in enumerate(keys) for q in keys[i + 1 :]), key=lambda x: dist[np.ix_(groups[x[0]], groups[x[1]])].min())
        groups[a] = groups[a] + groups.pop(b)
    order, w = next(iter(groups.values())), np.ones(len(cov))
    todo = [order]
    while todo:
        part = todo.pop()
        if len(part) < 2:
            continue
        left, right = part[: len(part) // 2], part[len(part) // 2 :]

        def risk(g):
            c = cov[np.ix_(g, g)]
            v = 1 / np.diag(c)
            v /= v.sum()
            return v @ c @ v

        share = 1 - risk(left) / (risk(left) + risk(right))
        w[left] *= share
        w[right] *= 1 - share
        todo += [left, right]
    return w / w.sum()


def mintorsion(cov: np.ndarray) -> dict[str, float]:
    """Effective number of bets of equal weights after the minimum torsion."""
    sd = np.sqrt(np.diag(cov))
    value, vector = np.linalg.eigh(cov / np.outer(sd, sd))
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-12))) @ vector.T
    torsion = np.diag(sd) @ root @ np.diag(1 / sd)
    w = np.linalg.solve(torsion.T, np.ones(len(cov)) / len(cov))
    var = torsion @ cov @ torsion.T
    p = w * (var @ w)
    p = np.maximum(p / p.sum(), 1e-15)
    return {"effective_bets": float(np.exp(-(p * np.log(p)).sum()))}


def blacklitterman(mean, cov, P, Q, tau: float = 0.05) -> np.ndarray:
    """Posterior mean."""
    mean, cov, P, Q = (np.asarray(v, float) for v in (mean, cov, P, Q))
    S = tau * cov
    omega = P @ S @ P.T + 1e-10 * np.eye(len(P))
    return mean + S @ P.T @ np.linalg.solve(P @ S @ P.T + omega, Q - P @ mean)


def project_simplex(v: np.ndarray) -> np.ndarray:
    u = np.sort(v)[::-1]
    c = (np.cumsum(u) - 1) / np.arange(1, len(v) + 1)
    return np.maximum(v - c[np.flatnonzero(u > c)[-1]], 0)


def meancvar(R: np.ndarray, alpha: float = 0.95, rounds: int = 3000) -> np.ndarray:
    """Long-only weights of least conditional value at risk, by projected subgradients."""
    n = R.shape[1]
    w = best = np.full(n, 1 / n)
    least = np.inf
    k = max(1, int(math.ceil((1 - alpha) * len(R))))
    for t in range(1, rounds + 1):
        loss = -(R @ w)
        worst = np.argpartition(-loss, k - 1)[:k]
        value = loss[worst].mean()
        if value < least:
            least, best = value, w
        g = -R[worst].mean(0)
        w = project_simplex(w - 0.5 / math.sqrt(t) * g / (np.linalg.norm(g) + 1e-12))
    return best


def synthcontrol(treated, donors, t_treat: int, rounds: int = 2000) -> dict:
    """Simplex weights of donors before t_treat by projected gradients, and the mean gap after it."""
    y, X = np.asarray(treated, float), np.asarray(donors, float)
    a, b = X[:t_treat], y[:t_treat]
    w = np.full(X.shape[1], 1 / X.shape[1])
    step = 1 / (np.linalg.norm(a, 2) ** 2 + 1e-12)
    for _ in range(rounds):
        w = project_simplex(w - step * a.T @ (a @ w - b))
    return {"weights": w, "att": float(np.mean(y[t_treat:] - X[t_treat:] @ w))}


def pcalgo(data: np.ndarray, alpha: float = 0.05, max_order: int = 3) -> np.ndarray:
    """Skeleton of the PC algorithm by Fisher's z tests of partial correlations."""
    from itertools import combinations

    n, k = data.shape
    corr = np.corrcoef(data.T)
    edge = ~np.eye(k, dtype=bool)
    for order in range(max_order + 1):
        for i, j in combinations(range(k), 2):
            if not edge[i, j]:
                continue
            others = [x for x in range(k) if x not in (i, j) and (edge[i, x] or edge[j, x])]
            for S in combinations(others, order):
                inv = np.linalg.pinv(corr[np.ix_([i, j, *S], [i, j, *S])])
                r = -inv[0, 1] / math.sqrt(inv[0, 0] * inv[1, 1])
                z = math.sqrt(max(1, n - order - 3)) * abs(math.atanh(max(-0.999999, min(0.999999, r))))
                if 2 * (1 - _N.cdf(z)) > alpha:
                    edge[i, j] = edge[j, i] = False
                    break
    return edge


# -- resampling ---------------------------------------------------------------------------


def stationary_bootstrap(n: int, mean_block: float, rng: np.random.Generator) -> np.ndarray:
    """Places of one Politis and Romano resample."""
    fresh = rng.random(n) < 1 / mean_block
    fresh[0] = True
    start = rng.integers(0, n, n)
    at = np.flatnonzero(fresh)
    origin = np.repeat(at, np.diff(np.append(at, n)))
    return (start[origin] + np.arange(n) - origin) % n


def spa(diff: np.ndarray, n_boot: int = 500, mean_block: float = 5.0, seed: int = 0) -> dict[str, float]:
    """Most studentised mean of alternatives less the benchmark, against recentred resamples."""
    rng, n = np.random.default_rng(seed), len(diff)
    sd = diff.std(0, ddof=1) + 1e-15
    stat = float(np.max(math.sqrt(n) * diff.mean(0) / sd))
    centred = diff - diff.mean(0)
    hits = sum(np.max(math.sqrt(n) * centred[stationary_bootstrap(n, mean_block, rng)].mean(0) / sd) >= stat for _ in range(n_boot))
    return {"stat": stat, "p": (hits + 1) / (n_boot + 1)}


def esbootstrap(r, alpha: float = 0.95, n_boot: int = 500, block: int = 21, seed: int = 0) -> dict[str, float]:
    """Expected shortfall with a moving-block bootstrap interval."""
    r = clean(r)
    es = lambda v: float(-np.sort(v)[: max(1, int((1 - alpha) * len(v)))].mean())
    rng, n = np.random.default_rng(seed), len(r)
    if n < 2 * block:
        return {"es": NAN, "low": NAN, "high": NAN}
    draws = [es(np.concatenate([r[s : s + block] for s in rng.integers(0, n - block + 1, -(-n // block))])[:n]) for _ in range(n_boot)]
    return {"es": es(r), "low": float(np.quantile(draws, 0.025)), "high": float(np.quantile(draws, 0.975))}


def covar(x, y, alpha: float = 0.95, rounds: int = 2000) -> float:
    """Conditional value at risk of y at x's, by a subgradient quantile regression of losses."""
    a, b = -np.asarray(x), -np.asarray(y)
    z, w = (a - a.mean()) / a.std(), (b - b.mean()) / b.std()
    beta = np.zeros(2)
    for t in range(1, rounds + 1):
        e = w - beta[0] - beta[1] * z
        g = np.where(e > 0, alpha, alpha - 1)
        beta = beta + np.array([g.mean(), (g * z).mean()]) / math.sqrt(t)
    return float((beta[0] + beta[1] * np.quantile(z, alpha)) * b.std() + b.mean())


def permtest(real: float, metric, x, y, n_perms: int = 1000, seed: int = 0) -> float:
    """Share of permutations of y with a metric at least as high."""
    rng = np.random.default_rng(seed)
    return (sum(metric(x, rng.permutation(y)) >= real for _ in range(n_perms)) + 1) / (n_perms + 1)


def grangerf(y, x, lag: int = 1) -> float:
    """F of x's lags in a regression of y on its own and x's."""
    rows = np.column_stack([y[lag - k - 1 : len(y) - k - 1] for k in range(lag)] + [np.ones(len(y) - lag)])
    full = np.column_stack([rows, *[x[lag - k - 1 : len(x) - k - 1] for k in range(lag)]])
    a, b = (float((_ols(y[lag:], X)[2] ** 2).sum()) for X in (rows, full))
    return (a - b) / lag / (b / (len(y) - lag - full.shape[1]))


def lasso(X: np.ndarray, y: np.ndarray, alphas=None, folds: int = 5, rounds: int = 500) -> dict:
    """Coordinate descent on standardised features; the alpha of least contiguous-fold error."""
    X, y = (X - X.mean(0)) / (X.std(0) + 1e-12), y - y.mean()
    alphas = np.logspace(-5, -1, 30) if alphas is None else alphas

    def fit(A, b, alpha):
        n, w = len(A), np.zeros(A.shape[1])
        gram, rhs = A.T @ A / n, A.T @ b / n
        for _ in range(rounds):
            old = w.copy()
            for j in range(len(w)):
                r = rhs[j] - gram[j] @ w + gram[j, j] * w[j]
                w[j] = math.copysign(max(abs(r) - alpha, 0), r) / (gram[j, j] + 1e-12)
            if np.abs(w - old).max() < 1e-8:
                break
        return w

    parts = np.array_split(np.arange(len(X)), folds)
    error = [sum(((y[p] - X[p] @ fit(np.delete(X, p, 0), np.delete(y, p), a)) ** 2).sum() for p in parts) for a in alphas]
    best = float(alphas[int(np.argmin(error))])
    return {"alpha": best, "weights": fit(X, y, best)}


# -- topology -------------------------------------------------------------------------------


def persistence(cloud: np.ndarray, max_dim: int = 1, most: float = np.inf) -> dict[int, np.ndarray]:
    """Vietoris-Rips birth and death pairs of dimensions 0 and 1, by reduction of the boundary matrix."""
    n = len(cloud)
    d = _far(cloud, False)
    edges = sorted((float(d[i, j]), i, j) for i in range(n) for j in range(i + 1, n) if d[i, j] <= most)
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    zero, loops = [], []
    index = {}
    for k, (v, i, j) in enumerate(edges):
        index[i, j] = k
        a, b = root(i), root(j)
        if a != b:
            parent[a] = b
            zero.append((0.0, v))
        else:
            loops.append(k)
    zero += [(0.0, np.inf)] * len({root(i) for i in range(n)})
    out = {0: np.array(zero)}
    if max_dim >= 1:
        triangles = sorted((max(d[i, j], d[i, k], d[j, k]), i, j, k) for i in range(n) for j in range(i + 1, n) if (i, j) in index for k in range(j + 1, n) if (i, k) in index and (j, k) in index)
        low: dict[int, set[int]] = {}
        pairs, open_ = [], set(loops)
        for v, i, j, k in triangles:
            column = {index[i, j], index[i, k], index[j, k]}
            while column and (top := max(column)) in low:
                column ^= low[top]
            if column:
                top = max(column)
                low[top] = column
                open_.discard(top)
                if v > edges[top][0]:
                    pairs.append((edges[top][0], float(v)))
            if not open_:
                break
        out[1] = np.array(pairs + [(edges[k][0], np.inf) for k in open_ if k not in low]).reshape(-1, 2)
    return out


def wasserstein(a: np.ndarray, b: np.ndarray, metric: str = "wasserstein", n_slices: int = 50) -> float:
    """Distance of finite diagram points, those left over matched to the diagonal."""
    a, b = (p[np.isfinite(p).all(1)] if len(p) else p.reshape(0, 2) for p in (np.asarray(a), np.asarray(b)))
    mid = lambda p: np.repeat(p.mean(1, keepdims=True), 2, 1)
    if metric == "sliced_wasserstein":
        u, v = np.vstack([a, mid(b)]), np.vstack([b, mid(a)])
        angles = np.linspace(-np.pi / 2, np.pi / 2, n_slices, endpoint=False)
        return float(np.mean([np.abs(np.sort(u @ t) - np.sort(v @ t)).sum() for t in np.column_stack([np.cos(angles), np.sin(angles)])]))
    n, m = len(a), len(b)
    cost = np.zeros((n + m, n + m))
    cost[:n, :m] = np.abs(a[:, None, :] - b[None, :, :]).max(2) if n and m else cost[:n, :m]
    cost[:n, m:] = ((a[:, 1] - a[:, 0]) / 2)[:, None]
    cost[n:, :m] = ((b[:, 1] - b[:, 0]) / 2)[None, :]
    if metric == "bottleneck":
        values = np.unique(cost)
        lo, hi = 0, len(values) - 1
        while lo < hi:
            k = (lo + hi) // 2
            lo, hi = (lo, k) if _matches(cost <= values[k]) else (k + 1, hi)
        return float(values[lo]) if len(values) else 0.0
    return _assign(cost)


def _matches(ok: np.ndarray) -> bool:
    """Whether a perfect matching exists."""
    to = [-1] * len(ok)

    def grow(i, seen):
        for j in np.flatnonzero(ok[i]).tolist():
            if j not in seen:
                seen.add(j)
                if to[j] < 0 or grow(to[j], seen):
                    to[j] = i
                    return True
        return False

    return all(grow(i, set()) for i in range(len(ok)))


def _assign(cost: np.ndarray) -> float:
    """Least total of an assignment, by shortest augmenting paths."""
    n = len(cost)
    u, v, p, way = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        p[0], j0 = i, 0
        least, used = np.full(n + 1, np.inf), np.zeros(n + 1, bool)
        while True:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            now = cost[p[j0] - 1, free - 1] - u[p[j0]] - v[free]
            better = now < least[free]
            least[free[better]], way[free[better]] = now[better], j0
            j1 = free[np.argmin(least[free])]
            delta = least[j1]
            u[p[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if p[j0] == 0:
                break
        while j0:
            p[j0], j0 = p[way[j0]], way[j0]
    return float(sum(cost[p[j] - 1, j - 1] for j in range(1, n + 1)))


def bettiseries(x, window: int = 40, stride: int = 20, dim: int = 1, embedding_dim: int = 3, delay: int = 1, min_persistence: float = 0.0) -> np.ndarray:
    """Features of at least this persistence in each strided window; NaN elsewhere."""
    x = np.asarray(x, float)
    out = np.full(len(x), np.nan)
    for end in range(window, len(x) + 1, stride):
        part = x[end - window : end]
        if np.isfinite(part).all():
            pairs = persistence(embed(part, embedding_dim, delay), dim)[dim]
            out[end - 1] = np.count_nonzero(pairs[:, 1] - pairs[:, 0] >= min_persistence) if len(pairs) else 0
    return out


# -- scans over feature libraries -----------------------------------------------------------


def polynomial(X: np.ndarray, degree: int = 2) -> np.ndarray:
    """Products of up to ``degree`` columns, without the constant."""
    from itertools import combinations_with_replacement

    return np.column_stack([np.prod(X[:, list(c)], 1) for d in range(1, degree + 1) for c in combinations_with_replacement(range(X.shape[1]), d)])


def symbolicscan(X: np.ndarray, y: np.ndarray, degree: int = 2) -> dict:
    return lasso(polynomial(X, degree), y)


def boosted(X: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.1):
    """Least-squares boosting of stumps over quantile thresholds; returns a predictor."""
    base, fit, stumps = y.mean(), np.full(len(y), y.mean()), []
    cuts = np.quantile(X, np.arange(1, 16) / 16, axis=0)
    above = X[:, None, :] > cuts[None]
    n1 = above.sum(0)
    n0 = len(y) - n1
    for _ in range(rounds):
        r = y - fit
        s1 = np.einsum("i,icj->cj", r, above)
        gain = s1**2 / np.maximum(n1, 1) + (r.sum() - s1) ** 2 / np.maximum(n0, 1)
        c, j = np.unravel_index(np.argmax(gain), gain.shape)
        left, right = (r.sum() - s1[c, j]) / max(n0[c, j], 1), s1[c, j] / max(n1[c, j], 1)
        stumps.append((j, cuts[c, j], rate * left, rate * right))
        fit = fit + np.where(above[:, c, j], rate * right, rate * left)
    return lambda Z: base + sum(np.where(Z[:, j] > t, b, a) for j, t, a, b in stumps)


def out_of_fold_r2(X: np.ndarray, y: np.ndarray, make, folds: int = 5) -> float:
    """R squared of predictions for contiguous folds by models of the others."""
    guess = np.empty(len(y))
    for part in np.array_split(np.arange(len(y)), folds):
        guess[part] = make(np.delete(X, part, 0), np.delete(y, part))(X[part])
    return float(1 - ((y - guess) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def linear(X: np.ndarray, y: np.ndarray):
    beta = np.linalg.lstsq(np.column_stack([X, np.ones(len(X))]), y, rcond=None)[0]
    return lambda Z: np.column_stack([Z, np.ones(len(Z))]) @ beta


def ridge(X: np.ndarray, y: np.ndarray, alpha: float = 1.0):
    m, c = X.mean(0), y.mean()
    beta = np.linalg.solve((X - m).T @ (X - m) + alpha * np.eye(X.shape[1]), (X - m).T @ (y - c))
    return lambda Z: (Z - m) @ beta + c


def kernel_mean(X: np.ndarray, y: np.ndarray):
    """Joint model: the mean of y given X under a Gaussian kernel density of both."""
    scale = X.std(0) * len(X) ** (-1 / (X.shape[1] + 4)) + 1e-12

    def predict(Z):
        w = np.exp(-0.5 * (((Z[:, None, :] - X[None]) / scale) ** 2).sum(2)) + 1e-300
        return w @ y / w.sum(1)

    return predict


def pinnscan(X: np.ndarray, y: np.ndarray, n_perms: int = 20, seed: int = 0) -> dict[str, float]:
    """Out-of-fold R squared of boosting and its permutation p."""
    rng = np.random.default_rng(seed)
    real = out_of_fold_r2(X, y, boosted)
    hits = sum(out_of_fold_r2(X, rng.permutation(y), boosted) >= real for _ in range(n_perms))
    return {"r2": real, "p": (hits + 1) / (n_perms + 1)}


def belltest(X: np.ndarray, y: np.ndarray) -> dict[str, float]:
    """Whether a joint model beats every single feature, linear, ridge and boosted model out of fold."""
    single = max(out_of_fold_r2(X[:, [j]], y, linear) for j in range(X.shape[1]))
    best = max(single, *(out_of_fold_r2(X, y, m) for m in (linear, ridge, boosted)))
    joint = out_of_fold_r2(X, y, kernel_mean)
    return {"best_classical": best, "joint": joint, "violation": float(joint > best)}


def mcs(returns: np.ndarray, alpha: float = 0.05, n_boot: int = 200, seed: int = 0) -> dict[str, float]:
    """Drops the worst of the strategies while it tests worse than the best; how many are left and the last p."""
    left, p = list(range(returns.shape[1])), 1.0
    while len(left) > 1:
        mean = returns[:, left].mean(0)
        worst, best = left[int(mean.argmin())], left[int(mean.argmax())]
        p = spa((returns[:, best] - returns[:, worst])[:, None], n_boot, seed=seed)["p"]
        if p > alpha:
            break
        left.remove(worst)
    return {"left": float(len(left)), "p": p}


def haar(x, n_scales: int = 5) -> list[np.ndarray]:
    """Details by scale, finest first, then the rest; odd ends are dropped."""
    out, level = [], np.asarray(x, float)
    for _ in range(n_scales):
        level = level[: len(level) // 2 * 2]
        if len(level) < 2:
            break
        out.append((level[0::2] - level[1::2]) / math.sqrt(2))
        level = (level[0::2] + level[1::2]) / math.sqrt(2)
    return [*out, level]
