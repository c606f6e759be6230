"""Queries against their SQL on small tables whose keys or order differ from the generated ones."""

import datetime

import duckdb
import pandas as pd
import pytest
from tests.test_catalogue import ORACLES, QUERIES, normal


def check(spark, folder, name):
    con = duckdb.connect()
    con.execute("SET threads = 1")
    for path in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    got, want = normal(QUERIES[name](spark, str(folder)).toPandas()), normal(con.execute(ORACLES[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9, atol=1e-9)
    return got


@pytest.mark.parametrize("first", [1, 799_990, 8_000_000])
def test_occparse_keeps_every_digit_of_a_strike(spark, tmp_path, first):
    orders = pd.DataFrame({"o_orderkey": range(100), "o_custkey": range(first, first + 100), "o_orderdate": [datetime.datetime(1996, 1 + k % 12, 5) for k in range(100)]})
    orders.to_parquet(tmp_path / "orders.parquet", coerce_timestamps="us")
    got = check(spark, tmp_path, "occparse")
    assert got["strike"].max() > (first + 90) / 8


def test_quantile_bins_do_not_depend_on_how_rows_are_dealt(spark, tmp_path):
    rows = [(10 * user + k, datetime.datetime(2024, 1, day, k), user, day * x) for day in (1, 2) for user in range(20) for k, x in enumerate((0.1, 0.2, 0.3) if user < 18 else (1.1, 2.2, 3.3))]
    events = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "value"])
    (tmp_path / "events.parquet").mkdir()
    late = events["event_id"] % 10 > events["user_id"] % 2  # the second value is in one file with the third, of odd users with the first
    for part in (0, 1):
        events[late == bool(part)].to_parquet(tmp_path / "events.parquet" / f"{part}.parquet", coerce_timestamps="us")
    events.to_parquet(tmp_path / "all.parquet", coerce_timestamps="us")
    con = duckdb.connect()
    con.execute(f"SET threads = 1; CREATE VIEW events AS SELECT * FROM '{tmp_path}/all.parquet' ORDER BY event_id")
    got, want = normal(QUERIES["mean_return_by_quantile"](spark, str(tmp_path)).toPandas()), normal(con.execute(ORACLES["mean_return_by_quantile"]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9, atol=1e-9)


def test_bh_takes_one_pass_over_the_ranks(spark):
    from tidewater.operators.performance import mht_correction

    p = [0.04, 0.01, 0.01, 0.03, 0.9, 0.2, 0.01]
    out = mht_correction(spark.createDataFrame(list(enumerate(p)), "id int, p double"), "p", "id")
    assert "currentrow$(), unboundedfollowing$()" not in out._jdf.queryExecution().toString()  # adds up the rest of the group for each row
    order = sorted(range(7), key=lambda k: (p[k], k))
    want = {k: min(1.0, *(p[j] * 7 / (i + 1) for i, j in enumerate(order) if i >= at)) for at, k in enumerate(order)}
    assert {r["id"]: r["adjusted"] for r in out.collect()} == pytest.approx(want)


def test_logsumexp_of_groups_holds_no_lists_of_rows(spark):
    import math

    from tidewater.functions.normal import logsumexp_by

    inf, nan = math.inf, math.nan
    groups = {1: [0.0, 700.0, -700.0, 31.9, 32.0, None], 2: [-1e6, -1e6 - 1], 3: [-inf, -inf], 4: [inf, -inf, 1.0], 5: [nan, 2.0], 6: [-inf, 5.0]}
    df = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "g int, x double")
    out = {r["g"]: r["v"] for r in logsumexp_by(df, "g", "x").collect()}
    want = {1: 700.0, 2: -1e6 + math.log(1 + math.exp(-1)), 3: -inf, 4: inf, 5: nan, 6: 5.0}
    assert out == pytest.approx(want, rel=1e-12, nan_ok=True)
    assert "collect_list(z" not in QUERIES["logsumexp"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_kernelpca_takes_whole_vectors(spark, tmp_path):
    import numpy as np

    from tidewater.functions import series as K

    rng = np.random.default_rng(3)
    X = rng.standard_normal((90, 12)) * np.r_[0.05 * np.ones(5), np.ones(7)]  # what varies lies beyond the first five
    pd.DataFrame({"vec_id": range(90), "label": [k % 2 for k in range(90)], "embedding": list(X.astype(np.float32))}).to_parquet(tmp_path / "embeddings.parquet")
    got = QUERIES["kernelpca"](spark, str(tmp_path)).toPandas().set_index("label")
    for label in (0, 1):
        part = X[label::2].astype(np.float32).astype(float)
        assert got.loc[label, ["v0", "v1", "v2"]].to_numpy(float) == pytest.approx(plain(part).var(0), abs=2e-6)
    assert K.kernelpca(X[:2]).shape == (2, 2)


def plain(X, k=3):
    import numpy as np

    gram = np.exp(-((X[:, None, :] - X[None, :, :]) ** 2).sum(2) / X.shape[1])
    gram = gram - gram.mean(0) - gram.mean(1)[:, None] + gram.mean()
    value, vector = np.linalg.eigh(gram)
    return (vector * np.sqrt(np.maximum(value, 0)))[:, ::-1][:, :k]


@pytest.mark.parametrize("held", [0, 300_000_000])
def test_kernelpca_by_blocks_equals_all_eigenvectors(held, monkeypatch):
    import numpy as np

    from tidewater.functions import series as K

    monkeypatch.setattr(K, "KERNEL_BYTES", held)
    rng = np.random.default_rng(4)
    X = rng.standard_normal((150, 8)) * np.linspace(1, 0.1, 8)
    X = np.concatenate([X, X[:40], X[10:90]])  # copies count as often as they are there
    got, want = K.kernelpca(X, dense=20), plain(X)
    assert np.abs(got) == pytest.approx(np.abs(want), abs=1e-7)
    assert np.abs(K.kernelpca(X)) == pytest.approx(np.abs(want), abs=1e-9)
