"""Informed shapes, mixtures, policy features, prints, searches and the further walks, on small tables."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.operators import asof as A
from tidecast.operators import study as T
from tidecast.operators import walks as W

DAY = dt.date(2020, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def test_newest_rows_as_of(spark):
    series = spark.createDataFrame([(k, day(n), float(n)) for k in "ab" for n in (0, 3, 4, 9)], "k string, date date, value double")
    wanted = spark.createDataFrame([("u", "a", day(4)), ("v", "a", day(100)), ("w", "b", day(-1)), ("x", "c", day(5)), ("y", "b", None)], "unit string, k string, as_of date")
    got = sorted((r.unit, r.age, r.pos, r.value) for r in A.newest_as_of(wanted, series, 2, ["k"]).collect())
    assert got == [("u", 1, 3, 4.0), ("u", 2, 2, 3.0), ("v", 1, 4, 9.0), ("v", 2, 3, 4.0)]


def test_shapes(spark):
    x = np.array([-3.0, -1.0, 0.0, 2.0, 7.0])
    draws = spark.createDataFrame([(i, 0, float(v)) for i, v in enumerate(x)], "draw int, cell int, value double")
    get = lambda shape, size, **more: np.array([r.value for r in T.shaped(draws, shape, size, F.lit(-1), ["cell"], **more).orderBy("draw").collect()])
    assert np.allclose(get("shift", 0.5), x - 0.5 * x.std()) and np.allclose(get("width", 0.2), 1 + 0.8 * (x - 1))
    assert np.allclose(get("tilt", 0.3), np.where(x < 0, 1.3, 0.7) * x) and np.allclose(get("calm", 0.5, quiet=F.lit(True)), 0.5 * x) and np.allclose(get("calm", 0.5, quiet=F.lit(False)), x)
    moved = get("mixture", 2.0, share=0.5)
    assert set(np.round((moved - x) / x.std(), 6)) <= {0.0, -2.0} and np.allclose(get("mixture", 2.0, share=1.0), x - 2 * x.std())


def test_scale_mixture_has_mean_square_one(spark):
    draws = spark.range(20000).select(F.col("id").alias("draw"), F.lit(0).alias("cell"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0).alias("value"))
    out = T.scale_mixture(draws, ["cell"], 0.3, F.lit(5.0), F.lit(2.0)).toPandas().value
    assert abs(out.mean() - 5) < 0.1 and abs(((out - 5) ** 2).mean() / 4 - 1) < 0.05


def test_policy_features(spark):
    cards = spark.createDataFrame([("none", day(0)), ("one", day(10)), ("later", day(400)), ("old", day(2000))], "unit_id string, as_of date")
    changes = spark.createDataFrame([(day(5), 25), (day(300), -50), (day(390), 75), (day(395), 0)], "date date, bp long")
    tones = spark.createDataFrame([(day(1), 0.5), (day(350), 0.25)], "date date, tone double")
    got = {r.unit_id: tuple(round(r[c], 6) for c in ("s1", "s2", "s3", "x1", "x2")) for r in T.policy_features(cards, changes, tones).collect()}
    assert got == {"none": (0, 0, 2, 0, 0), "one": (1, 0.25, round(5 / 365, 6), 0.5, 0), "later": (1, 0.25, round(10 / 365, 6), 0.25, -0.25), "old": (1, 0, 2, 0.25, -0.25)}


def test_study_against_numpy(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 2))
    y = (r.random(400) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    rows = spark.createDataFrame([(i, float(a), float(b), int(z), i < 300) for i, ((a, b), z) in enumerate(zip(x, y, strict=True))], "k int, a double, b double, y int, train boolean")
    found, models = T.study(rows, {"none": [], "both": ["a", "b"]}, "y", F.col("train"), "k")
    got = {f.arm: f for f in found.collect()}
    s = (x - x[:300].mean(0)) / (x[:300].std(0) + 1e-9)
    z = np.c_[np.ones(400), s]
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z[:300] @ w))
        w -= np.linalg.solve((z[:300] * (p * (1 - p))[:, None]).T @ z[:300] + np.diag([0, 1 / 0.3, 1 / 0.3]), z[:300].T @ (p - y[:300]) + np.array([0, 1, 1]) / 0.3 * w)
    p = 1 / (1 + np.exp(-z[300:] @ w))
    assert models["both"]["weights"] == pytest.approx(w[1:], rel=1e-6) and got["both"].hits == pytest.approx(((p > 0.5) == (y[300:] == 1)).mean())
    ranks = np.argsort(np.argsort(p)) + 1
    n1 = y[300:].sum()
    assert got["both"].auc == pytest.approx((ranks[y[300:] == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (100 - n1))) and got["none"].n == 100


def test_prints_move_the_anchor(spark):
    month = lambda n: dt.date(2020 + (n - 1) // 12, (n - 1) % 12 + 1, 1)
    history = spark.createDataFrame([("a", month(n), float(n)) for n in range(1, 6)] + [("b", month(5), 5.0)], "asset string, date date, value double")
    prints = spark.createDataFrame([("a", month(n), n * 10.0) for n in (5, 6, 7, 9)] + [("b", month(7), 70.0)], "asset string, ref date, value double")
    rows, left = T.append_prints(history, spark.createDataFrame([("a", 1), ("a", 6), ("b", 6)], "asset string, steps int"), prints)
    assert [(r.asset, r.date, r.value) for r in rows.filter("value >= 10").orderBy("date").collect()] == [("a", month(6), 60.0), ("a", month(7), 70.0)]
    assert sorted((r.asset, r.steps) for r in left.collect()) == [("a", 1), ("a", 4), ("b", 6)]


def test_descent_goes_axis_by_axis(spark):
    grid = spark.createDataFrame([(float(k), float(s), float((k - 2) ** 2 + (s - 1) ** 2 + (k - 2) * (s - 1))) for k in range(5) for s in range(-3, 4)], "k double, s double, score double")
    way = T.coordinate_descent(grid, ["k", "s"], {"k": 0.0, "s": -3.0}, rounds=9)
    assert way[0] == {"step": 1, "axis": "k", "k": 4.0, "s": -3.0, "score": 12.0} and (way[-1]["k"], way[-1]["s"]) == (2.0, 1.0)


def test_staleness(spark):
    panel = spark.createDataFrame([("a", day(n), float(n)) for n in range(0, 100, 10)], "asset string, date date, value double")
    miss = T.staleness(spark.createDataFrame([("u", day(55), "a")], "unit_id string, as_of date, asset string"), panel, spark.createDataFrame([("u", "a", 5, 60.0)], "unit_id string, asset string, horizon int, value double"))
    assert [(r.fresh, r.stale) for r in miss.collect()] == [(10.0, 40.0)]


def test_further_walks():
    r = np.random.default_rng(4)
    h = 100 + np.cumsum(r.normal(0.1, 1, size=(400, 2)), axis=0)
    g = W.garch_walk(h, [1, 25], 4000, "u")
    assert g.shape == (4000, 2, 2) and np.allclose(g.mean(axis=0)[:, 1], h[-1] + 25 * np.diff(h, axis=0).mean(axis=0), atol=1.0) and np.allclose(g.std(axis=0)[:, 1] / g.std(axis=0)[:, 0], 5, rtol=0.25)
    s = W.segment_walk(h, [1, 4, 4], 6000, "u", recent=0.0, drift=0.0, tau=0.0)
    sd = np.diff(h, axis=0).std(axis=0)
    assert np.array_equal(s[:, :, 1], s[:, :, 2]) and np.allclose(s.std(axis=0)[:, 0], sd, rtol=0.05) and np.allclose(s.std(axis=0)[:, 1], 2 * sd, rtol=0.05)
    assert np.corrcoef(s[:, 0, 0] - h[-1, 0], s[:, 0, 1] - h[-1, 0])[0, 1] == pytest.approx(0.5, abs=0.05)
    wide = W.segment_walk(h, [1], 6000, "u", recent=0.0, drift=0.0, tau=0.5)[:, 0, 0]
    assert np.mean((wide - h[-1, 0]) ** 2) == pytest.approx(sd[0] ** 2, rel=0.15)
