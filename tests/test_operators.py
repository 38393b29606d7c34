"""Operators on small made-up inputs, against plain Python."""

import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidecast.functions import text as X
from tidecast.operators import asof as A
from tidecast.operators import forecast as M
from tidecast.operators import gates as G
from tidecast.operators import inference as I
from tidecast.operators import panels as P
from tidecast.operators import scoring as S
from tidecast.sources import files


def test_hole_is_dropped_and_gap_kept(spark):
    days = [0, 1, 2, 3, 4, 5, 6, 7, 1100, 1101]
    rows = [("a", pd.Timestamp("2020-01-01") + pd.Timedelta(days=k), float(k % 5)) for k in days]
    p = spark.createDataFrame(pd.DataFrame(rows, columns=["asset", "date", "value"])).withColumn("date", F.to_date("date"))
    assert P.drop_holes(p).count() == len(days) - 2


def test_steps_need_consecutive_months(spark):
    p = spark.createDataFrame([("a", "2020-01-01", 1.0), ("a", "2020-02-01", 2.0), ("a", "2020-04-01", 9.0), ("a", "2020-05-01", 10.0)], "asset string, date string, value double").withColumn("date", F.to_date("date"))
    assert sorted(r.step for r in P.monthly_steps(p).collect()) == [1.0, 1.0]


def test_strict_log_step_fails(spark):
    with pytest.raises(Exception, match="simple return"):
        spark.createDataFrame([(-1.0,)], "r double").select(P.strict_log_step(F.col("r"))).collect()


def test_rounding_is_half_even(spark):
    r = spark.createDataFrame([(21, 11.76)], "h int, s double").select(P.panel_steps_for(F.col("h"), F.col("s")).alias("n")).first()
    assert r.n == 2  # 2.5 rounds to 2, and 21 / 2 is far from 1


@pytest.mark.parametrize("keys", [["k"], []])
def test_as_of_join(spark, keys):
    rng = np.random.default_rng(1)
    base = pd.Timestamp("1999-01-01")
    left = pd.DataFrame({"id": range(60), "k": rng.integers(0, 3, 60), "t": base + pd.to_timedelta(rng.integers(0, 1500, 60), "D")})
    right = pd.DataFrame({"k": rng.integers(0, 3, 40), "s": base + pd.to_timedelta(rng.integers(0, 1500, 40), "D"), "v": range(40)}).drop_duplicates(["k", "s"] if keys else ["s"])
    got = A.as_of_join(spark.createDataFrame(left), spark.createDataFrame(right if keys else right.drop(columns="k")), keys, "t", "s", ["v"], 200).toPandas().set_index("id")
    for r in left.itertuples():
        known = right[(right.s <= r.t) & ((right.k == r.k) if keys else True)].sort_values("s")
        want = known.v.iloc[-1] if len(known) and (r.t - known.s.iloc[-1]).days <= 200 else None
        assert (None if pd.isna(got.v[r.id]) else got.v[r.id]) == want


def _draws(m=40, d=3, seed=3):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(m, d)), rng.normal(size=d)


def test_scores_against_numpy(spark):
    x, y = _draws()
    m, d = x.shape
    draws = spark.createDataFrame([(i, c, float(x[i, c])) for i in range(m) for c in range(d)], "draw int, cell int, value double")
    out = spark.createDataFrame([(c, float(y[c])) for c in range(d)], "cell int, y double")
    crps = np.mean([np.abs(x[:, c] - y[c]).mean() - np.abs(x[:, c][:, None] - x[:, c][None]).mean() / 2 for c in range(d)])
    vario = sum((np.sqrt(abs(y[a] - y[b])) - np.sqrt(np.abs(x[:, a] - x[:, b])).mean()) ** 2 for a in range(d) for b in range(a + 1, d))
    energy = np.linalg.norm(x - y, axis=1).mean() - np.linalg.norm(x[:, None] - x[None], axis=2).mean() / 2
    got = S.components(draws, out).first()
    assert np.allclose([got.marginal, got.joint], [crps, vario]) and np.isclose(S.energy(draws, out).first().energy, energy)
    q = {a: np.quantile(x, a, axis=0) for a in S.TAIL_LEVELS}
    assert np.isclose(got.tail, np.mean([np.where(y >= q[a], a * (y - q[a]), (1 - a) * (q[a] - y)).mean() for a in q]))
    assert np.isclose(S.coverage(draws, out).first().coverage, sum(abs((y <= q[a]).mean() - a) for a in q))


def test_single_cell_has_no_joint_weight(spark):
    r = spark.range(1).select(S.composite(F.lit(1.2), F.lit(9.0), F.lit(0.8), F.lit(1)).alias("c")).first()
    assert np.isclose(r.c, 1.2 * 5 / 7 + 0.8 * 2 / 7)


def test_roster_counts_failures(spark):
    roster = spark.createDataFrame([("a",), ("b",), ("c",)], "unit_id string")
    scores = spark.createDataFrame([("a", 1.0), ("b", 9.0), ("z", 0.5)], "unit_id string, score double")
    assert tuple(G.roster_mean(roster, scores).first()) == (3, 1, 1, 3.0)


def _card(spark, d=2):
    cells = spark.createDataFrame([("u", c, f"a{c}", 21, 21, 100.0) for c in range(d)], "unit_id string, cell int, asset string, horizon int, steps int, anchor double")
    mu = spark.createDataFrame([("u", f"a{c}", 0.1) for c in range(d)], "unit_id string, asset string, mu double")
    cov = spark.createDataFrame([("u", f"a{a}", f"a{b}", 1.0 if a == b else 0.5) for a in range(d) for b in range(d)], "unit_id string, asset_a string, asset_b string, cov double")
    return cells, M.cell_moments(cells, mu, cov, ["unit_id"])


@pytest.mark.parametrize("method", ["m0", "student"])
def test_draws_repeat_and_match_moments(spark, method):
    cells, pairs = _card(spark)
    a = M.sample(pairs, cells, 4000, method).toPandas()
    b = M.sample(pairs.repartition(3), cells.repartition(2), 4000, method).toPandas()
    keys = ["unit_id", "draw", "asset", "horizon"]
    assert a.sort_values(keys).reset_index(drop=True).equals(b.sort_values(keys).reset_index(drop=True))
    wide = a.pivot(index="draw", columns="asset", values="value")
    assert set(a.method) == {method} and np.allclose(wide.mean(), 102.1, atol=0.4) and np.allclose(wide.cov(), [[21, 10.5], [10.5, 21]], atol=2.5)


def test_ladder_falls_to_independent_cells(spark):
    cells, pairs = _card(spark)
    broken = pairs.filter("a = b")
    assert set(M.sample(broken, cells, 500, "student").toPandas().method) == {"independent"}


def test_seed_in_sql_is_zlibs(spark):
    r = spark.createDataFrame([("card-2020-01-01",)], "u string").select(M.seed(F.col("u")).alias("s")).first()
    assert r.s == M.seed_of("card-2020-01-01")


def test_nearest_correlation():
    c = M.nearest_correlation(np.array([[1, 0.9, np.nan], [0.9, 1, -0.9], [np.nan, -0.9, 1]]))
    assert np.linalg.eigvalsh(c).min() > -1e-12 and np.allclose(np.diag(c), 1)


def test_numbered_and_ranks(spark):
    rng = np.random.default_rng(5)
    v = rng.integers(0, 40, 500)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "id long, v double")
    got = I.numbered(df, ["v", "id"]).toPandas().sort_values("rn")
    assert got.rn.tolist() == list(range(1, 501)) and got.equals(got.sort_values(["v", "id"]))
    ranks = I.with_average_rank(df, "v", "r").toPandas().set_index("id").r.sort_index()
    assert np.allclose(ranks, pd.Series(v.astype(float)).rank())


def test_logistic_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 2))
    y = (rng.random(300) < 1 / (1 + np.exp(-x[:, 0]))).astype(int)
    m = I.logistic(spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y)], "a double, b double, y int"), ["a", "b"], "y")
    z = np.c_[np.ones(300), (x - x.mean(0)) / (x.std(0) + 1e-9)]
    w = np.array([m["intercept"], *m["weights"]])
    gradient = z.T @ (1 / (1 + np.exp(-z @ w)) - y) + np.diag([0, 1 / 0.3, 1 / 0.3]) @ w
    assert np.abs(gradient).max() < 1e-6


def test_ranks_and_numbers_with_half_the_rows_equal(spark, monkeypatch):
    monkeypatch.setattr(I, "BUCKET_ROWS", 40)
    rng = np.random.default_rng(11)
    v = np.where(rng.random(600) < 0.5, 7.0, np.round(rng.normal(size=600), 1))
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)] + [(600, None)], "k int, v double").repartition(5)
    got = {r.k: r.r for r in I.with_average_rank(df, "v", "r").collect()}
    assert got.pop(600) is None and all(got[i] == (v < x).sum() + ((v == x).sum() + 1) / 2 for i, x in enumerate(v))
    n = I.numbered(df.filter("v is not null"), ["v", "k"], "n")
    order = sorted(range(600), key=lambda i: (v[i], i))
    assert [r.k for r in n.orderBy("n").collect()] == order and n.agg(F.max("n")).first()[0] == 600
    assert I.numbered(df.limit(0), ["v"], "n").count() == 0


def test_permutation_p_is_uniform_under_no_effect(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, float(a), float(b), i % 3) for i, (a, b) in enumerate(rng.normal(size=(60, 2)))], "k int, x double, y double, g int")
    r = I.permutation_test(df, "x", "y", "g", "k", 49).first()
    assert 0 <= r.exceed <= 49 and np.isclose(r.p, (r.exceed + 1) / 50)


def test_files(spark, tmp_path):
    good = tmp_path / "a.json"
    good.write_text('{"k": 1}')
    assert files.read_json(str(good)) == {"k": 1}
    os.symlink(good, tmp_path / "link.json")
    os.mkfifo(tmp_path / "pipe")
    (tmp_path / "list.json").write_text("[1]")
    for name in ("link.json", "pipe", "list.json"):
        with pytest.raises(files.Refused):
            files.read_json(str(tmp_path / name))
    with pytest.raises(files.Refused):
        files.read_json(str(good), 3)
    pd.DataFrame({"a": [1, 2]}).to_parquet(tmp_path / "t.parquet")
    assert files.footer(str(tmp_path / "t.parquet"))["rows"] == 2
    with pytest.raises(files.Refused):
        files.footer(str(tmp_path / "t.parquet"), max_rows=1)
    with pytest.raises(files.Refused):
        files.read_exact(spark.read.parquet(str(tmp_path / "t.parquet")), ["a", "b"])


def test_sinks(spark, tmp_path):
    files.write_results(spark.createDataFrame([("u", 1.0)], "unit_id string, score double"), str(tmp_path / "out"))
    assert os.path.isdir(tmp_path / "out" / "details")
    lines = [json.loads(x) for f in (tmp_path / "out" / "scores").glob("*.json") for x in f.read_text().splitlines()]
    assert lines == [{"unit_id": "u", "score": 1.0}]
