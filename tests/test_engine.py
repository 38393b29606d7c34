"""The main engine: each path, the ladder, and the draws' moments."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.operators import engine as E
from tidecast.plans import engine_queries as Q

SCHEMA = "unit_id string, kind string, asset string, date date, value double"


def series(unit, kind, asset, values, start=dt.date(2000, 1, 3), every=1, hole=None):
    days = [start + dt.timedelta(days=every * i + (400 if hole and i >= hole else 0)) for i in range(len(values))]
    return [(unit, kind, asset, day, float(v)) for day, v in zip(days, values, strict=True)]


def run(spark, rows, cells, cards, variants=None, **options):
    known = spark.createDataFrame(rows, SCHEMA)
    c = E.parameterised(spark.createDataFrame(cards, "unit_id string, kind string, family string, n_cells int, context_log_vol double"), variants)
    cells = spark.createDataFrame(cells, "unit_id string, asset string, horizon int, months int")
    named, pairs = E.moments(known, cells, c, **options)
    return known, cells, named, pairs


def test_a_transfer_card_is_scaled_by_log_steps_and_has_no_drift(spark):
    r = np.random.default_rng(1)
    early = np.exp(np.cumsum(r.normal(0, 0.02, 200))) * 100
    rows = series("t", "level", "x", [*early, 500.0], hole=200)
    for mode, want in (("geo", 500 * np.sqrt(np.diff(np.log(early)).std(ddof=1) * 0.01)), ("log_early", 500 * np.diff(np.log(early)).std(ddof=1)), ("ctx", 5.0)):
        _, _, named, pairs = run(spark, rows, [("t", "x", 4, None)], [("t", "level", "T2-F1", 1, 0.01)], transfer=mode)
        cell, pair = named.first(), pairs.first()
        assert cell.mean == 500 and cell.nu == E.DEFAULTS["transfer_nu"] and cell.steps == 4
        assert pair.scale == pytest.approx(4 * want**2)


def test_single_multi_and_family_parameters(spark):
    r = np.random.default_rng(2)
    x, y = np.cumsum(r.normal(0.1, 1, 400)), np.cumsum(r.normal(0, 2, 400))
    rows = series("s", "level", "x", x) + series("m", "level", "x", x) + series("m", "level", "y", y)
    cards = [("s", "level", "T2-F4", 1, None), ("m", "level", "T2-F4", 2, None)]
    _, _, named, pairs = run(spark, rows, [("s", "x", 9, None), ("m", "x", 9, None), ("m", "y", 9, None)], cards)
    step = np.diff(x)[-300:]
    spacing_steps = 13  # nine business days in steps of one calendar day: 12.6, less than twice nine, so nine stays
    assert spacing_steps / 9 < 2
    by = {(c.unit_id, c.asset): c for c in named.collect()}
    assert by["s", "x"].mean == pytest.approx(x[-1] + 0.5 * 9 * step.mean()) and by["m", "x"].mean == pytest.approx(x[-1] + 0.9 * 9 * step.mean())
    lively = np.clip(np.sqrt((step[-21:] ** 2).mean()) / step.std(ddof=1), 0.5, 2) ** 0.5
    scale = {(p.unit_id, p.asset_a, p.asset_b): (p.scale, p.corr) for p in pairs.collect()}
    assert scale["s", "x", "x"][0] == pytest.approx(9 * (step.std(ddof=1) * lively * 1.1) ** 2)
    other = np.diff(y)[-300:]
    assert scale["m", "x", "y"] == (pytest.approx(9 * step.std(ddof=1) * other.std(ddof=1) * (1.05 * 1.1) ** 2), pytest.approx(np.corrcoef(step, other)[0, 1]))


def test_monthly_and_return_cards(spark):
    r = np.random.default_rng(3)
    months = [dt.date(1990 + i // 12, i % 12 + 1, 1) for i in range(120)]
    level = np.cumsum(r.normal(0, 1, 120))
    rows = [("m", "monthly", "x", d, float(v)) for d, v in zip(months, level, strict=True) if d != dt.date(1995, 6, 1)]
    back = r.normal(0, 0.01, 400)
    rows += series("r", "returns", "x", back)
    _, _, named, pairs = run(spark, rows, [("m", "x", 1, 7), ("r", "x", 5, None)], [("m", "monthly", "T2-F1", 1, None), ("r", "returns", "T2-F1", 1, None)])
    kept = np.delete(np.diff(level), [64, 65])  # the steps to and from the missing month
    by, var = {c.unit_id: c for c in named.collect()}, {p.unit_id: p.scale for p in pairs.collect()}
    assert by["m"].steps == 7 and by["m"].nu == 5 and by["m"].mean == pytest.approx(level[-1] + 7 * kept.mean()) and var["m"] == pytest.approx(7 * kept.var(ddof=1))
    log = np.log1p(back)[-300:]
    assert by["r"].mean == pytest.approx(0.5 * 5 * log.mean())


def test_fractional_paths_and_variants(spark):
    rows = series("s", "level", "x", np.cumsum(np.random.default_rng(4).normal(0, 1, 300)))
    card = [("s", "level", "T2-F1", 2, None)]
    _, _, _, pairs = run(spark, rows, [("s", "x", 4, None), ("s", "x", 8, None)], card, {"base": {}, "rough": {"hurst": 0.3}})
    cov = {(p.variant, p.a, p.b): p.scale for p in pairs.collect()}
    unit = cov["base", 0, 0] / 4
    assert cov["base", 0, 1] == pytest.approx(4 * unit) and cov["rough", 0, 1] == pytest.approx(0.5 * (4**0.6 + 8**0.6 - 4**0.6) * unit)


def test_the_ladder_goes_down_to_a_walk_that_always_writes(spark):
    r = np.random.default_rng(5)
    rows = series("full", "level", "x", np.cumsum(r.normal(0, 1, 300)) + 50) + series("short", "level", "x", [1.0, 2.0, 4.0]) + series("flat", "level", "x", [7.0] * 100)
    cards = [(u, "level", "T2-F1", 1, None) for u in ("full", "short", "flat", "none")]
    known, cells, named, pairs = run(spark, rows, [(u, "x", 5, None) for u in ("full", "short", "flat", "none")], cards)
    walk = E.walk_cells(known, cells)
    first = {x.unit_id: x for x in walk.collect()}
    assert (first["none"].anchor, first["none"].spread) == (0, 1e-4) and (first["flat"].anchor, first["flat"].spread) == (7, pytest.approx(0.07))
    m0 = spark.createDataFrame([("short", 0, 0, 3.0, 4.0)], "unit_id string, a int, b int, mean_a double, cov double")
    drawn = E.draws(named, pairs, walk, m0, 4000).toPandas()
    by = drawn.groupby("unit_id")
    assert by.method.first().to_dict() == {"full": "engine", "short": "m0", "flat": "walk", "none": "walk"} and (by.size() == 4000).all() and np.isfinite(drawn.value).all()
    assert abs(by.value.mean()["short"] - 3) < 0.2 and abs(by.value.std()["short"] - 2) < 0.1
    assert abs(by.value.std()["flat"] / (0.07 * np.sqrt(first["flat"].steps) * 1.1) - 1) < 0.05
    full, cell = drawn[drawn.unit_id == "full"].value, named.first()
    assert abs(full.mean() - cell.mean) < 0.1 * full.std() and full.std() == pytest.approx(np.sqrt(pairs.first().scale), rel=0.1)
    assert drawn.value.sum() == pytest.approx(E.draws(named, pairs, walk, m0, 4000).agg(F.sum("value")).first()[0])


def test_shocks_are_of_unit_variance_and_share_their_scale():
    z = E.student_shocks(np.eye(2), 200_000, 8.0, np.random.default_rng(1))
    assert np.abs(z.std(axis=0) - 1).max() < 0.02 and np.corrcoef(np.abs(z.T))[0, 1] > 0.05
    mixed = E.student_shocks(np.eye(2), 200_000, 8.0, np.random.default_rng(1), 0.1, 3.0)
    wide = np.isclose(mixed, 3 * z).all(axis=1)
    assert abs(wide.mean() - 0.1) < 0.01 and np.isclose(mixed[~wide], z[~wide]).all()


def test_correlations_shrink_to_their_average():
    c = np.array([[1, 0.8, 0.2], [0.8, 1, 0.5], [0.2, 0.5, 1]])
    assert np.allclose(E.shrunk(c, 1.0), [[1, 0.5, 0.5], [0.5, 1, 0.5], [0.5, 0.5, 1]]) and E.shrunk(c, 0.0) is c


def test_query_uses_every_shape(spark):
    cards, cells, known = Q.inputs(spark, "/root/testdata/sf0.01")
    stepped = E.steps(known)
    assert {r.kind for r in cards.select("kind").distinct().collect()} == {"level", "monthly", "returns"}
    assert stepped.filter("hole").select("unit_id").distinct().count() >= 3
