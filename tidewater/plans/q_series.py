"""Queries of kernels over whole series, matrices and resamples; those that pairs of rows or counts can say have SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import series as K
from ..operators import per_series as S
from .catalogue import register
from .views import Views, with_views

_RQA = ("recurrence_rate", "determinism", "laminarity", "longest", "entropy")


#: Three values in a row, with their number.
_EMBEDDED = "e AS (SELECT s, r AS a, lead(r, 1) OVER w AS b, lead(r, 2) OVER w AS c, row_number() OVER w AS i FROM ret WINDOW w AS (PARTITION BY s ORDER BY d)), t AS (SELECT s, 0.2::DOUBLE * stddev_samp(r) AS r FROM ret GROUP BY s)"
_NEAR = "abs(x.a - y.a) <= t.r AND abs(x.b - y.b) <= t.r"


def _embedded(body: str) -> str:
    return with_views("##" + body, "ret").replace(" ##", f", {_EMBEDDED} ")


SQL = {
    "kendalltau": with_views("SELECT 'F-O' AS s, round(sum(sign(x.a - y.a) * sign(x.b - y.b)) / sqrt(sum(abs(sign(x.a - y.a)))::DOUBLE * sum(abs(sign(x.b - y.b)))), 6) + 0.0::DOUBLE AS value FROM both_ x, both_ y", "both"),
    "permutationentropy": _embedded("SELECT s, round(-sum(q * ln(q)) / ln(6), 6) + 0.0::DOUBLE AS value FROM (SELECT s, count(*) / sum(count(*)) OVER (PARTITION BY s) AS q FROM e WHERE c IS NOT NULL GROUP BY s, a <= b, b <= c, a <= c) GROUP BY s"),
    "sampleentropy": _embedded(f"SELECT s, round(-ln(count(*) FILTER (abs(x.c - y.c) <= t.r) / count(*)), 6) + 0.0::DOUBLE AS value FROM e x JOIN e y USING (s) JOIN t USING (s) WHERE x.i < y.i AND {_NEAR} GROUP BY s"),
    "approximateentropy": _embedded(f"SELECT s, round(avg(ln(two / n)) - avg(ln(three / (n - 1))) FILTER (three > 0), 6) + 0.0::DOUBLE AS value FROM (SELECT s, x.i, count(*) AS two, count(*) FILTER (abs(x.c - y.c) <= t.r) AS three FROM e x JOIN e y USING (s) JOIN t USING (s) WHERE {_NEAR} GROUP BY s, x.i) JOIN (SELECT s, count(b) AS n FROM e GROUP BY s) USING (s) GROUP BY s"),
}


def _one(name: str, kernel, out: tuple[str, ...] = ("value",), prices: bool = False) -> None:
    register(name, lambda v: S.per_series(v.px if prices else v.ret, "s", ["d"], ["x" if prices else "r"], kernel, out), SQL.get(name))


def _two(name: str, kernel, out: tuple[str, ...] = ("value",)) -> None:
    register(name, lambda v: S.per_series(v.both.withColumn("s", F.lit("F-O")), "s", ["d"], ["a", "b"], kernel, out), SQL.get(name))


for _name in ("hurstrs", "dfa", "higuchihurst", "localwhittle", "wavelethurst", "spectralentropy", "permutationentropy", "sampleentropy", "approximateentropy", "dispersionentropy", "corrdim", "mutualinfo", "lyapunov"):
    _one(_name, getattr(K, _name))
_one("mfdfa", K.mfdfa, ("h_m4", "h_m2", "h_0", "h_2", "h_4"))
_one("bdstest", K.bdstest, ("z", "p"))
_one("adftest", K.adftest, ("stat", "lag"), True)
_one("kpsstest", K.kpsstest, ("stat", "lags"), True)
_one("phillipsperrontest", K.phillipsperrontest, ("stat",), True)
_one("shapirowilk", K.shapirowilk, ("w", "p"))
_one("falsenearest", K.falsenearest, ("dimension", "share_1", "share_last"))
_one("knnlyapunov", lambda x: K.lyapunov(x, k_neighbors=5))
_one("rqa", K.rqa, _RQA)
_one("chaosscan", lambda x: {"tau": 1.0, "dimension": K.falsenearest(x)["dimension"], "lyapunov": K.lyapunov(x), "corrdim": K.corrdim(x), "determinism": K.rqa(x)["determinism"]}, ("tau", "dimension", "lyapunov", "corrdim", "determinism"))
_one("esbootstrap", K.esbootstrap, ("es", "low", "high"))
_one("emd", lambda x: {"modes": float(len(m := K.emd(x)) - 1), "gap": float(np.abs(m.sum(0) - x).max())}, ("modes", "gap"))
_one("stationary_bootstrap", lambda x: {"mean": float(x[K.stationary_bootstrap(len(x), 5.0, np.random.default_rng(0))].mean()), "n": float(len(x))}, ("mean", "n"))
register("persistenthomology", lambda v: S.per_window(v.ret, "s", ["d"], ["r"], lambda x: {f"n{k}": float(len(p)) for k, p in K.persistence(K.embed(x, 3)).items()}, ("n0", "n1"), 60))
_one("tcdf", lambda x: {"p": K.tcdf(float(x.mean() / x.std() * len(x) ** 0.5), len(x) - 1.0), "log_p": K.logtcdf(-5.0, 4.0), "q": K.tppf(0.975, len(x) - 1.0)}, ("p", "log_p", "q"))
for _name in ("distancecorr", "transferentropy", "covar"):
    _two(_name, getattr(K, _name))
_two("kendalltau", K.kendall)
_two("andrewsse", K.andrewsse, ("alpha", "beta", "se_alpha", "se_beta", "bandwidth"))
_two("crossrecurrence", K.crossrecurrence, _RQA)
_two("jointrecurrence", K.jointrecurrence, _RQA)
_two("ccm", K.ccm, ("rho_50", "rho_100", "rho_200", "rho_400"))
_two("grangerscan", lambda a, b: {f"f_{k}": K.grangerf(a, b, k) for k in (1, 2, 5)}, ("f_1", "f_2", "f_5"))
_two("permtest", lambda a, b: K.permtest(abs(np.corrcoef(a, b)[0, 1]), lambda x, y: abs(np.corrcoef(x, y)[0, 1]), a, b, 1_000))
_two("spa_test", lambda a, b: K.spa(np.column_stack([a, b])), ("stat", "p"))
_two("sindylasso", lambda a, b: (lambda m: {"alpha": m["alpha"], "w0": m["weights"][0], "w1": m["weights"][1]})(K.lasso(np.column_stack([b, b * b]), a)), ("alpha", "w0", "w1"))
_METRICS = ("wasserstein", "bottleneck", "sliced_wasserstein")
register("wasserstein", lambda v: S.per_window(v.both.withColumn("s", F.lit("F-O")), "s", ["d"], ["a", "b"], lambda a, b: {m: K.wasserstein(*(K.persistence(K.embed(x, 2), 0)[0] for x in (a, b)), m) for m in _METRICS}, _METRICS, 40))
_two("synthcontrol", lambda a, b: K.synthcontrol(a, np.column_stack([b, b[::-1]]), len(a) // 2)["att"])
register("rollhurst", lambda v: S.rollhurst(v.ret, "s", ["d"], "r"))
register("rollcoherence", lambda v: S.rollcoherence(v.both.withColumn("s", F.lit("F-O")), "s", ["d"], "a", "b", 64))
register("bettiseries", lambda v: S.per_row_of_series(v.ret, "s", ["d"], ["r"], lambda r: {"value": K.bettiseries(r)}, {"value": "double"}))

_PI, _A, _MU, _SD = [0.6, 0.4], [[0.9, 0.1], [0.2, 0.8]], [-0.1, 0.1], [0.3, 0.6]
_B = [[0.5, 0.4, 0.1], [0.1, 0.3, 0.6]]


def _symbols(r: np.ndarray) -> np.ndarray:
    return np.log(np.array(_B)[:, np.digitize(r, [-0.1, 0.1])].T)


for _kind, _log in (("ghmm", lambda r: K.gaussian_log(r, _MU, _SD)), ("hmm", _symbols)):
    _one(f"{_kind}_forward", lambda r, f=_log: K.hmm_log(f(r), _PI, _A)[2])
    _one(f"{_kind}_backward", lambda r, f=_log: (lambda b, g: float(np.logaddexp.reduce(np.log(_PI) + b[0] + g[0])))(K.hmm_log(f(r), _PI, _A)[1], f(r)))
    register(f"{_kind}_viterbi", lambda v, f=_log: S.per_row_of_series(v.ret, "s", ["d"], ["r"], lambda r: {"state": K.hmm_viterbi(f(r), _PI, _A)[0]}, {"state": "bigint"}))
    register(f"{_kind}_posterior", lambda v, f=_log: S.per_row_of_series(v.ret, "s", ["d"], ["r"], lambda r: {"p0": K.hmm_posterior(f(r), _PI, _A)[0][:, 0]}, {"p0": "double"}))
_one("ghmm_baumwelch", lambda r: (lambda m: {"log_likelihood": m["log_likelihood"], "mu0": m["mu"][0], "mu1": m["mu"][1], "iterations": float(m["iterations"])})(K.baumwelch(r, 2, max_iter=20)), ("log_likelihood", "mu0", "mu1", "iterations"))
_one("hmm_baumwelch", lambda r: (lambda m: {"log_likelihood": m["log_likelihood"], "iterations": float(m["iterations"])})(K.baumwelch(np.digitize(r, [-0.1, 0.1]), 2, 3, max_iter=20)), ("log_likelihood", "iterations"))

# -- matrices over the first components of vectors -----------------------------------
_C = [f"e{k}" for k in range(1, 6)]


def _wide(v: Views):
    return v.table("embeddings").select("vec_id", "label", *[F.element_at("embedding", k).cast("double").alias(f"e{k}") for k in range(1, 6)])


def _weights(name: str, solve) -> None:
    register(name, lambda v: v.spark.createDataFrame([(c, float(w)) for c, w in zip(_C, solve(*S.matrix(_wide(v), _C)), strict=True)], "asset string, weight double"))


_weights("riskparity", lambda m, c: K.riskparity(c))
_weights("hrp", lambda m, c: K.hrp(c))
_weights("blacklitterman", lambda m, c: K.blacklitterman(m, c, [[1, -1, 0, 0, 0]], [0.01]))
register("mintorsion", lambda v: v.spark.createDataFrame([(K.mintorsion(S.matrix(_wide(v), _C)[1])["effective_bets"],)], "effective_bets double"))


def _by_label(name: str, kernel, out: tuple[str, ...]) -> None:
    register(name, lambda v: S.per_series(_wide(v), "label", ["vec_id"], _C, lambda *x: dict(zip(out, kernel(np.column_stack(x)), strict=True)), out))


_by_label("whitening", lambda X: [float(np.abs(K.whitening(X).T @ K.whitening(X) / len(X) - np.eye(5)).max())], ("gap",))
_by_label("ica", lambda X: [float(np.abs(np.corrcoef(K.ica(X).T) - np.eye(5)).max())], ("most_corr",))
register("kernelpca", lambda v: S.per_matrix(v.table("embeddings"), "label", ["vec_id"], "embedding", lambda X: K.kernelpca(X).var(0), ("v0", "v1", "v2")))
_by_label("meancvar", lambda X: K.meancvar(X), tuple(_C))
_by_label("pcalgo", lambda X: [float(K.pcalgo(X).sum() / 2)], ("edges",))
register("decoherencescan", lambda v: S.walk_forward(v.both.withColumn("s", F.lit("F-O")), "s", ["d"], ["b"], "a", S.linear_fit, S.linear_predict, 250, 20).filter("day IS NOT NULL AND NOT isnan(day)").groupBy(F.floor(F.col("day") / 5).alias("bucket")).agg(F.corr("prediction", "truth").alias("corr"), F.count("*").alias("n")))
register("zenoscan", lambda v: S.zenoscan(v.both.withColumn("s", F.lit("F-O")), "s", ["d"], ["b"], "a", S.linear_fit, S.linear_predict, 250, (5, 21, 63)))
_two("nocloningscan", lambda a, b: S.seed_spread(lambda seed: S.subsampled_fit()(seed, b[:, None], a), 8), ("r2_mean", "r2_std", "r2_cv", "pair_corr_mean", "pair_corr_std"))
register("bootstrap_ic", lambda v: S.per_series(v.both.withColumn("s", F.lit("F-O")), "s", ["d"], ["a", "b"], lambda a, b: (lambda c: {"low": float(np.quantile(c, 0.025)), "high": float(np.quantile(c, 0.975))})([np.corrcoef(a[i], b[i])[0, 1] for i in (K.stationary_bootstrap(len(a), 5.0, np.random.default_rng(k)) for k in range(300))]), ("low", "high")))

_two("symbolicscan", lambda a, b: (lambda m: {"alpha": m["alpha"], "w0": m["weights"][0], "w1": m["weights"][1]})(K.symbolicscan(b[:, None], a)), ("alpha", "w0", "w1"))
_two("pinnscan", lambda a, b: K.pinnscan(np.column_stack([b, np.roll(b, 1)]), a), ("r2", "p"))
_two("belltest", lambda a, b: K.belltest(np.column_stack([b, np.roll(b, 1)]), a), ("best_classical", "joint", "violation"))
_two("mcs_test", lambda a, b: K.mcs(np.column_stack([a, b])), ("left", "p"))
_one("wavelet", lambda x: {f"energy_{k}": float((d * d).sum()) for k, d in enumerate(K.haar(x))}, tuple(f"energy_{k}" for k in range(6)))
