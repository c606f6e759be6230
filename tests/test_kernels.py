"""Kernels against identities and closed forms."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.functions import series as K

RNG = np.random.default_rng(42)


def test_student_distribution():
    assert K.tcdf(0.0, 5) == pytest.approx(0.5)
    assert K.tcdf(1.0, 1) == pytest.approx(0.75, abs=1e-12)  # Cauchy
    for p in (0.01, 0.3, 0.975):
        assert K.tcdf(K.tppf(p, 7.0), 7.0) == pytest.approx(p, abs=1e-12)


def test_chi_squared_tail():
    assert K.chi2sf(2.0, 2) == pytest.approx(math.exp(-1), abs=1e-12)


def test_hmm_forward_equals_backward_and_posterior_sums_to_one():
    x = RNG.standard_normal(60)
    log = K.gaussian_log(x, [-1, 1], [1, 0.5])
    pi, A = [0.6, 0.4], [[0.7, 0.3], [0.4, 0.6]]
    alpha, beta, like = K.hmm_log(log, pi, A)
    assert np.logaddexp.reduce(np.log(pi) + log[0] + beta[0]) == pytest.approx(like, abs=1e-9)
    assert np.allclose(K.hmm_posterior(log, pi, A)[0].sum(1), 1)


def test_baumwelch_never_gets_worse():
    x = np.concatenate([RNG.normal(-1, 0.3, 200), RNG.normal(1, 0.3, 200)])
    history = K.baumwelch(x, 2)["history"]
    assert all(b >= a - 1e-6 for a, b in zip(history, history[1:]))


def test_viterbi_beats_every_path():
    from itertools import product

    x = RNG.standard_normal(7)
    log, pi, A = K.gaussian_log(x, [-1, 1], [1, 1]), [0.5, 0.5], [[0.8, 0.2], [0.3, 0.7]]
    path, best = K.hmm_viterbi(log, pi, A)
    score = lambda p: math.log(pi[p[0]]) + log[0, p[0]] + sum(math.log(A[a][b]) + log[t + 1, b] for t, (a, b) in enumerate(zip(p, p[1:])))
    assert best == pytest.approx(max(score(p) for p in product((0, 1), repeat=7)))
    assert score(path.tolist()) == pytest.approx(best)


def test_memory_exponents_of_noise():
    x = RNG.standard_normal(4000)
    assert abs(K.dfa(x) - 0.5) < 0.1
    assert abs(K.hurstrs(x) - 0.55) < 0.12
    assert abs(K.localwhittle(x) - 0.5) < 0.1
    assert abs(K.wavelethurst(x) - 0.5) < 0.15


def test_unit_root_tests_tell_a_walk_from_noise():
    noise = RNG.standard_normal(500)
    walk = np.cumsum(noise)
    assert K.adftest(noise)["stat"] < -5 < -2.9 < K.adftest(walk)["stat"]
    assert K.kpsstest(walk)["stat"] > 0.463 > K.kpsstest(noise)["stat"]
    assert K.phillipsperrontest(noise)["stat"] < -5


def test_emd_adds_up():
    x = np.sin(np.linspace(0, 40, 300)) + 0.3 * np.sin(np.linspace(0, 300, 300))
    assert np.allclose(K.emd(x).sum(0), x)


def test_whitening_and_portfolios():
    X = RNG.standard_normal((500, 4)) @ RNG.standard_normal((4, 4))
    assert np.allclose(K.whitening(X).T @ K.whitening(X) / 500, np.eye(4), atol=1e-6)
    cov = np.cov(X.T)
    w = K.riskparity(cov)
    part = w * (cov @ w)
    assert np.allclose(part / part.sum(), 0.25, atol=1e-4)
    assert K.hrp(cov).sum() == pytest.approx(1)
    assert 1 <= K.mintorsion(cov)["effective_bets"] <= 4


def test_persistence_of_a_circle():
    t = np.linspace(0, 2 * np.pi, 24, endpoint=False)
    found = K.persistence(np.column_stack([np.cos(t), np.sin(t)]))
    assert len(found[0]) == 24
    assert len(found[1]) == 1
    assert found[1][0, 1] > 1.5


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.floats(1, 2)), min_size=1, max_size=5))
def test_diagram_distance_to_itself_is_zero(points):
    a = np.array(points)
    for metric in ("wasserstein", "bottleneck", "sliced_wasserstein"):
        assert K.wasserstein(a, a, metric) == pytest.approx(0, abs=1e-9)


def test_stationary_bootstrap_keeps_blocks():
    i = K.stationary_bootstrap(50, 5.0, np.random.default_rng(0))
    assert len(i) == 50 and ((0 <= i) & (i < 50)).all()
    assert np.mean(np.diff(i) % 50 == 1) > 0.5


def test_blocked_kernels_equal_whole_matrices(monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.standard_normal(320).cumsum() * 0.1 + rng.standard_normal(320)
    r = 0.2 * x.std(ddof=1)

    def pairs(m):
        e = [x[i : i + m] for i in range(len(x) - m + 1)]
        return sum(np.abs(e[i] - e[j]).max() <= r for i in range(len(e)) for j in range(i))

    want = -math.log(pairs(3) / pairs(2))
    names = {"sampleentropy": K.sampleentropy, "approximateentropy": K.approximateentropy, "corrdim": K.corrdim, "lyapunov": K.lyapunov, "falsenearest": lambda v: K.falsenearest(v)["share_1"]}
    whole = {n: f(x) for n, f in names.items()}
    assert whole["sampleentropy"] == pytest.approx(want)
    real = K._far_blocks
    monkeypatch.setattr(K, "_far_blocks", lambda p, chebyshev=True, cells=0: real(p, chebyshev, 7 * len(p)))
    assert {n: f(x) for n, f in names.items()} == pytest.approx(whole)
    y = x + rng.standard_normal(320)
    concordant = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(len(x)) for j in range(i))
    assert K.kendall(x, y) == pytest.approx(concordant / (len(x) * (len(x) - 1) / 2))


def test_kernels_read_whole_series():
    rng = np.random.default_rng(7)
    calm, wild = np.sin(np.arange(3000) / 9) + 0.01 * rng.standard_normal(3000), rng.standard_normal(2200)
    both = np.concatenate([wild, calm])
    for kernel in (K.sampleentropy, K.approximateentropy, K.corrdim, K.lyapunov, lambda x: K.falsenearest(x)["share_1"]):
        assert kernel(both) != pytest.approx(kernel(both[-2000:]), rel=1e-3)


def test_tail_probabilities(spark):
    from pyspark.sql import functions as F

    from tidewater.functions.normal import chi2sf
    from tidewater.operators import performance as M

    published = {1: 3.841459, 2: 5.991465, 3: 7.814728, 4: 9.487729, 5: 11.070498, 10: 18.307038}  # of 5 per cent
    row = spark.range(1).select(*[chi2sf(F.lit(x), k).alias(f"p{k}") for k, x in published.items()], M.andersondarling_p(F.lit(0.752)).alias("ad"), chi2sf(F.lit(-1.0), 3).alias("low")).first()
    assert all(row[f"p{k}"] == pytest.approx(0.05, abs=1e-7) for k in published)
    assert row["ad"] == pytest.approx(0.05, abs=2e-3) and row["low"] == 1.0


def test_windows_tile_series_and_seeds_spread(spark):
    from tidewater.operators import per_series as S

    df = spark.createDataFrame([("a", i, float(i)) for i in range(25)] + [("b", i, 1.0) for i in range(4)], "s string, d int, x double")
    got = sorted((r["s"], r["d"], r["n"], r["total"]) for r in S.per_window(df, "s", ["d"], ["x"], lambda x: {"n": float(len(x)), "total": float(x.sum())}, ("n", "total"), 10).collect())
    assert got == [("a", 9, 10.0, 45.0), ("a", 19, 10.0, 145.0), ("a", 24, 10.0, 195.0), ("b", 3, 4.0, 4.0)]
    spread = S.seed_spread(lambda seed: (np.arange(5.0) * (seed + 1), {"m": float(seed)}), 3, 1)
    assert spread["m_mean"] == 2.0 and spread["m_cv"] == pytest.approx(np.std([1, 2, 3]) / 2) and spread["pair_corr_mean"] == pytest.approx(1.0)
    wave = spark.createDataFrame([("a", i, float(i % 7), 2.0 * (i % 7) + 1) for i in range(60)], "s string, d int, x double, y double")
    scan = {r["frequency"]: r for r in S.zenoscan(wave, "s", ["d"], ["x"], "y", S.linear_fit, S.linear_predict, 20, (5, 40)).collect()}
    assert {f: (r["retrains"], r["n"]) for f, r in scan.items()} == {5: (8, 40), 40: (1, 40)}
    assert all(r["mse"] == pytest.approx(0, abs=1e-18) for r in scan.values())


def test_solvers_give_volatilities_back(spark):
    from pyspark.sql import functions as F

    from tidewater.functions import options as O

    rows = [(100.0, k, t, 0.03, v) for k in (60.0, 100.0, 140.0) for t in (0.1, 1.0) for v in (0.15, 0.6)] + [(100.0, None, 1.0, 0.0, 0.2), (100.0, 0.0, 1.0, 0.0, 0.2)]
    made = spark.createDataFrame(rows, "S double, K double, T double, r double, sigma double")
    made = made.withColumn("price", O.bscall(*[F.col(c) for c in ("S", "K", "T", "r", "sigma")])).withColumn("vega", O.bsvega(*[F.col(c) for c in ("S", "K", "T", "r", "sigma")])).toPandas()
    priced = spark.createDataFrame(made)
    args = [F.col(c) for c in ("price", "S", "K", "T", "r")]
    for r in priced.select("*", O.impvol(*args).alias("a"), O.impvolbisection(*args).alias("b")).collect():
        if r["K"] is None or not r["K"] > 0:
            assert r["a"] is None and r["b"] is None
        elif r["vega"] > 1:
            assert r["a"] == pytest.approx(r["sigma"], abs=1e-6) and r["b"] == pytest.approx(r["sigma"], abs=1e-6)
