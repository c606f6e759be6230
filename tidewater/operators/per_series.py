"""Kernels over whole series as grouped Arrow functions: one key per call, keys in parallel."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from ..functions import series as K


def per_series(df: DataFrame, key: str, order: list[str], columns: list[str], kernel: Callable, out: tuple[str, ...] = ("value",)) -> DataFrame:
    """key and the kernel's numbers: kernel takes the columns as arrays in order and returns a number or a dict with the names of ``out``.

    Rows with a null in a column are left out; NaN results become null.
    """
    kind = dict(df.dtypes)[key]

    def run(pdf):
        import pandas as pd

        pdf = pdf.dropna(subset=columns).sort_values(order, kind="stable")
        got = kernel(*[pdf[c].to_numpy(float) for c in columns])
        got = got if isinstance(got, dict) else {out[0]: got}
        row = {c: [None if not np.isfinite(got.get(c, np.nan)) else float(got[c])] for c in out}
        return pd.DataFrame({key: pdf[key].iloc[:1].tolist() or [None], **row})

    def keyed(k, pdf):
        made = run(pdf)
        made[key] = [k[0]]
        return made

    return df.select(*dict.fromkeys([key, *order, *columns])).groupBy(key).applyInPandas(keyed, f"{key} {kind}, " + ", ".join(f"{c} double" for c in out))


def per_row_of_series(df: DataFrame, key: str, order: list[str], columns: list[str], kernel: Callable, out: dict[str, str]) -> DataFrame:
    """df's key and order columns with the kernel's arrays beside them, one number per row."""
    types = dict(df.dtypes)

    def run(pdf):
        pdf = pdf.dropna(subset=columns).sort_values(order, kind="stable")
        got = kernel(*[pdf[c].to_numpy(float) for c in columns])
        for name in out:
            pdf[name] = got[name]
        return pdf[[key, *order, *out]]

    return df.select(*dict.fromkeys([key, *order, *columns])).groupBy(key).applyInPandas(run, ", ".join(f"{c} {types[c]}" for c in [key, *order]) + ", " + ", ".join(f"{c} {t}" for c, t in out.items()))


def per_matrix(df: DataFrame, key: str, order: list[str], vector: str, kernel: Callable, out: tuple[str, ...]) -> DataFrame:
    """key and the kernel's numbers: kernel takes the vectors of a key, whole, as rows of a matrix in order and returns as many numbers as it has.

    Rows with a null or NaN in the vector are left out; missing and NaN results are null.
    """
    kind = dict(df.dtypes)[key]

    def keyed(k, pdf):
        import pandas as pd

        rows = [np.asarray(x, float) for x in pdf.sort_values(order, kind="stable")[vector] if x is not None]
        rows = [x for x in rows if not np.isnan(x).any()]
        got = dict(zip(out, kernel(np.stack(rows)))) if rows else {}
        return pd.DataFrame({key: [k[0]], **{c: [None if not np.isfinite(got.get(c, np.nan)) else float(got[c])] for c in out}})

    return df.select(key, *order, vector).groupBy(key).applyInPandas(keyed, f"{key} {kind}, " + ", ".join(f"{c} double" for c in out))


def per_window(df: DataFrame, key: str, order: list[str], columns: list[str], kernel: Callable, out: tuple[str, ...], window: int) -> DataFrame:
    """key, order and out at the last row of each window; windows tile a series, and the last one ends with it, so every value is in one.

    A series shorter than the window is one window.
    """

    def tiled(*x):
        n = len(x[0])
        full = {name: np.full(n, np.nan) for name in out}
        for end in dict.fromkeys([*range(window, n + 1, window), n] if n else []):
            for name, value in kernel(*[v[max(0, end - window) : end] for v in x]).items():
                full[name][end - 1] = value
        return full

    every = per_row_of_series(df, key, order, columns, tiled, dict.fromkeys(out, "double"))
    return every.dropna(subset=list(out), how="all")


def zenoscan(df: DataFrame, key: str, order: list[str], features: list[str], target: str, fit: Callable, predict: Callable, train: int, frequencies: tuple[int, ...]) -> DataFrame:
    """By key and retrain frequency: retrains, n predictions, their mean squared error and correlation with the truth."""
    from functools import reduce

    from pyspark.sql import functions as F

    if any(f < 1 for f in frequencies):
        raise ValueError(f"frequencies must be positive, not {frequencies}")
    scans = [walk_forward(df, key, order, features, target, fit, predict, train, f).withColumn("frequency", F.lit(f)) for f in frequencies]
    rows = reduce(DataFrame.unionByName, scans).filter("prediction IS NOT NULL AND NOT isnan(prediction)")
    return rows.groupBy(key, "frequency").agg(F.sum((F.col("day") == 0).cast("bigint")).alias("retrains"), F.count("*").alias("n"), F.avg(F.pow(F.col("prediction") - F.col("truth"), 2)).alias("mse"), F.corr("prediction", "truth").alias("corr"))


def seed_spread(fit_predict: Callable, n_seeds: int, base_seed: int = 0) -> dict[str, float]:
    """Of fit_predict(seed) -> (predictions, metrics): every metric's mean, std and cv over seeds, and how seeds' predictions correlate in pairs."""
    if n_seeds < 2:
        raise ValueError(f"n_seeds must be 2 or more, not {n_seeds}")
    runs = [fit_predict(base_seed + k) for k in range(n_seeds)]
    out = {}
    for name in runs[0][1]:
        values = np.array([m[name] for _, m in runs])
        mean, spread = values.mean(), values.std()
        out |= {f"{name}_mean": float(mean), f"{name}_std": float(spread), f"{name}_cv": float(spread / abs(mean)) if abs(mean) > 1e-12 else np.inf}
    pairs = np.corrcoef([p for p, _ in runs])[np.triu_indices(n_seeds, 1)]
    pairs = pairs[np.isfinite(pairs)]
    pairs = pairs if len(pairs) else np.ones(1)
    return out | {"pair_corr_mean": float(pairs.mean()), "pair_corr_std": float(pairs.std())}


def subsampled_fit(share: float = 0.6) -> Callable:
    """A seed's linear model of a random share of the rows, its predictions of all and its r2 there."""

    def one(seed: int, X: np.ndarray, y: np.ndarray):
        own = np.random.default_rng(seed).choice(len(y), max(2, int(share * len(y))), replace=False)
        guess = linear_predict(linear_fit(X[own], y[own]), X)
        return guess, {"r2": float(1 - ((y - guess) ** 2).sum() / ((y - y.mean()) ** 2).sum())}

    return one


def rollhurst(df: DataFrame, key: str, order: list[str], x: str, window: int = 252, min_w: int = 8, n_windows: int = 8) -> DataFrame:
    def kernel(v):
        full = np.full(len(v), np.nan)
        for t in range(window - 1, len(v)):
            full[t] = K.hurstrs(v[t - window + 1 : t + 1], min_w, None, n_windows)
        return {"value": full}

    return per_row_of_series(df, key, order, [x], kernel, {"value": "double"})


def rollcoherence(df: DataFrame, key: str, order: list[str], x: str, y: str, window: int, band: tuple[float, float] = (0.0, 0.5)) -> DataFrame:
    """Mean squared coherence in the band by Welch's segments (Hann, half overlapping) of each trailing window."""
    size = max(8, window // 2)

    def one(a, b):
        hann = np.hanning(size + 1)[:size]
        starts = range(0, window - size + 1, size // 2)
        fa, fb = (np.array([np.fft.rfft((v[s : s + size] - v[s : s + size].mean()) * hann) for s in starts]) for v in (a, b))
        cross, pa, pb = (fa * fb.conj()).mean(0), (np.abs(fa) ** 2).mean(0), (np.abs(fb) ** 2).mean(0)
        f = np.arange(len(cross)) / size
        ok = (f >= band[0]) & (f < band[1]) & (pa * pb > 0)
        return float(np.mean(np.abs(cross[ok]) ** 2 / (pa * pb)[ok])) if ok.any() else np.nan

    def kernel(a, b):
        full = np.full(len(a), np.nan)
        for t in range(window - 1, len(a)):
            full[t] = one(a[t - window + 1 : t + 1], b[t - window + 1 : t + 1])
        return {"value": full}

    return per_row_of_series(df, key, order, [x, y], kernel, {"value": "double"})


def matrix(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of some columns by one aggregation: columns x columns numbers reach the driver, no rows."""
    from pyspark.sql import functions as F

    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.covar_samp(a, b).alias(f"c{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]).first()
    n = len(columns)
    return np.array([row[f"m{i}"] for i in range(n)]), np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])


def walk_forward(df: DataFrame, key: str, order: list[str], features: list[str], target: str, fit: Callable, predict: Callable, train: int, step: int) -> DataFrame:
    """key, order, prediction, truth, day: fit on ``train`` rows, predict the next ``step``, move on; day counts rows since the fit."""

    def kernel(y, *xs):
        X = np.column_stack(xs)
        guess, day = np.full(len(y), np.nan), np.full(len(y), np.nan)
        for at in range(train, len(y), step):
            model = fit(X[at - train : at], y[at - train : at])
            to = min(at + step, len(y))
            guess[at:to], day[at:to] = predict(model, X[at:to]), np.arange(to - at)
        return {"prediction": guess, "truth": y, "day": day}

    return per_row_of_series(df, key, order, [target, *features], kernel, {"prediction": "double", "truth": "double", "day": "double"})


def linear_fit(X: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(np.column_stack([X, np.ones(len(X))]), y, rcond=None)[0]


def linear_predict(beta: np.ndarray, X: np.ndarray) -> np.ndarray:
    return np.column_stack([X, np.ones(len(X))]) @ beta


def resampled(spark, n: int, one: Callable[[int], dict[str, float]], out: tuple[str, ...], base_seed: int = 0) -> DataFrame:
    """One row by seed, seeds in parallel: seed and the numbers of ``out``."""
    import pandas as pd

    def run(parts):
        for pdf in parts:
            yield pd.DataFrame([{"seed": int(s), **one(base_seed + int(s))} for s in pdf["seed"]])

    return spark.range(n).withColumnRenamed("id", "seed").mapInPandas(run, "seed bigint, " + ", ".join(f"{c} double" for c in out))
