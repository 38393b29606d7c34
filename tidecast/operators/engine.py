"""The main forecast engine: features of each card's series, moments of its cells, and draws with a ladder of fallbacks.

A card is one forecast problem: as-of date, series, horizons, and a kind that says how a series steps (level, monthly, returns).
Its newest rows come from ``asof.newest_as_of``. All features are windows and aggregations by (card, series); a parameter is a
column, so a table of variants is scored like a table of cards. Only cell moments, a few numbers a card, reach Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .forecast import DRAWS, factor, nearest_correlation, no_draws, seed_of
from .panels import hole_threshold, log_step, month_ordinal, panel_steps_for

WINDOW, SHORT = 300, 21
LEAST_STEPS, LEAST_LOG_STEPS, LEAST_COMMON = 20, 100, 30
# The engine's parameters, what changes for daily cards of several cells, and the width of event families.
DEFAULTS = {
    "drift": 0.5, "nu": 8.0, "k": 1.0, "beta": 0.5, "w_long": 0.0, "hurst": 0.5, "corr_shrink": 0.0, "k_single": 1.0, "transfer_k": 1.0, "transfer_nu": 4.0,
    "mix_p": 0.0, "mix_m": 1.0, "monthly_drift": 1.0, "monthly_k": 1.0, "monthly_nu": 5.0,
}
MULTI = {"drift": 0.9, "nu": 8.0, "k": 1.05, "beta": 0.0}
FAMILIES = {"T2-F4": 1.10, "T2-F2": 1.05}
WALK_WIDTH = 1.1  # of the last rung

CARD = ["variant", "unit_id"]


def parameterised(cards: DataFrame, variants: dict[str, dict] | None = None) -> DataFrame:
    """cards (unit_id, kind, family, n_cells, ...) once for each variant, with a column for each parameter."""
    rows = []
    for name, changed in (variants or {"base": {}}).items():
        single, multi = DEFAULTS | changed, DEFAULTS | MULTI | changed
        several = (F.col("n_cells") > 1) & (F.col("kind") != "monthly")
        rows.append(F.struct(F.lit(name).alias("variant"), *[F.when(several, float(multi[p])).otherwise(float(single[p])).alias(p) for p in DEFAULTS]))
    return cards.withColumn("__v", F.explode(F.array(*rows))).select("*", "__v.*").drop("__v")


def steps(known: DataFrame, window: int = WINDOW) -> DataFrame:
    """known (unit_id, kind, asset, date, value) with step, log_step, their ages (1 for the newest that is not null), and hole: whether the
    newest rows span a data hole. A step over a hole of the dates, or of the months, is null."""
    own = Window.partitionBy("unit_id", "asset")
    line, back = own.orderBy("date"), own.orderBy(F.desc("date"))
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    rows = known.withColumns({
        "age": F.row_number().over(back), "gap": F.datediff("date", F.lag("date").over(line)), "move": F.col("value") - F.lag("value").over(line),
        "months": month_ordinal(F.col("date")) - F.lag(month_ordinal(F.col("date"))).over(line),
        "up": F.last(F.when(F.col("value") > 0, F.struct("date", "value")), ignorenulls=True).over(before),
    })
    rows = rows.withColumn("log_gap", F.when(F.col("value") > 0, F.datediff("date", F.col("up.date"))))
    rows = rows.withColumns({"limit": hole_threshold(F.col("gap"), own), "log_limit": hole_threshold(F.col("log_gap"), own), "near": hole_threshold(F.when(F.col("age") < window, F.col("gap")), own)})
    level = F.when(F.col("kind") == "monthly", F.when(F.col("months") == 1, F.col("move"))).otherwise(F.when(F.col("gap") <= F.col("limit"), F.col("move")))
    rows = rows.withColumns({
        "step": F.when(F.col("kind") == "returns", log_step(F.col("value"))).otherwise(level),
        "log_step": F.when(F.col("log_gap") <= F.col("log_limit"), F.log("value") - F.log("up.value")),
        "hole": F.coalesce(F.col("kind") == "level", F.lit(False)) & F.coalesce(F.max(F.when(F.col("age") < window, F.col("gap") > F.col("near"))).over(own), F.lit(False)),
    })
    return rows.withColumn("step_age", F.when(F.col("step").isNotNull(), F.sum(F.col("step").isNotNull().cast("int")).over(back))).drop("move", "months", "up", "limit", "log_gap", "log_limit", "near")


def features(stepped: DataFrame, cards: DataFrame, window: int = WINDOW, transfer: str = "geo") -> DataFrame:
    """By (variant, unit_id, asset): n_steps, sd, mu, last, spacing and whether the series is a transfer: one whose newest rows span a hole,
    so that its level steps are of another time. Its sd is that of its log steps, or the geometric mean with the context's, at the
    newest level, without drift. transfer: m0 (as any other), log_early, geo or ctx. cards: parameterised, with context_log_vol."""
    s = F.col("step")
    new = F.col("step_age") <= window
    whole = stepped.groupBy("unit_id", "asset").agg(
        F.count(s).alias("n_steps"), F.stddev_samp(F.when(new, s)).alias("sd_window"), F.stddev_samp(s).alias("sd_long"),
        F.sqrt(F.avg(F.when(F.col("step_age") <= SHORT, s * s))).alias("sd_short"), F.avg(F.when(new, s)).alias("mean_step"),
        F.max_by("value", "date").alias("newest"), F.stddev_samp("log_step").alias("sd_log"), F.count("log_step").alias("n_log"), F.max("hole").alias("hole"),
        F.count(F.when(F.col("age") <= window, F.col("gap"))).alias("n_gaps"), F.median(F.when(F.col("age") <= window, F.col("gap"))).alias("mid_gap"),
        F.collect_list(F.when(F.col("age") <= window, F.col("gap"))).alias("gaps"),
    )
    short = F.filter("gaps", lambda g: g <= F.greatest(F.col("mid_gap") * 10.0, F.lit(5.0)))
    spacing = F.when(F.col("n_gaps") < 3, 1.4).otherwise(F.coalesce(F.try_divide(F.aggregate(short, F.lit(0.0), lambda a, g: a + g), F.size(short)), F.lit(1.4)))
    f = whole.join(cards, "unit_id").withColumn("spacing", spacing)
    plain = F.sqrt((1 - F.col("w_long")) * F.col("sd_window") * F.col("sd_window") + F.col("w_long") * F.col("sd_long") * F.col("sd_long"))
    lively = F.pow(F.least(F.greatest(F.try_divide("sd_short", "sd_window"), F.lit(0.5)), F.lit(2.0)), F.when(F.col("kind") == "monthly", 0.0).otherwise(F.col("beta")))
    early = {"geo": F.sqrt(F.col("sd_log") * F.coalesce("context_log_vol", "sd_log")), "ctx": F.coalesce("context_log_vol", "sd_log")}.get(transfer, F.col("sd_log"))
    moved = F.lit(transfer != "m0") & F.col("hole") & (F.col("n_log") >= LEAST_LOG_STEPS)
    return f.select(
        *CARD, "asset", "n_steps", "spacing", F.col("hole").alias("transfer"), F.when(moved, F.col("newest") * early).otherwise(plain * lively).alias("sd"),
        F.when(moved, 0.0).otherwise(F.col("mean_step")).alias("mu"), F.when(F.col("kind") == "returns", 0.0).otherwise(F.col("newest")).alias("last"),
    )


def correlations(stepped: DataFrame, window: int = WINDOW) -> DataFrame:
    """(unit_id, asset_a, asset_b, corr) over the dates that both series have a step of; 0 with fewer than LEAST_COMMON of them."""
    by_date = stepped.filter(F.col("step_age") <= window).groupBy("unit_id", "date").agg(F.collect_list(F.struct("asset", "step")).alias("all"))
    pairs = by_date.select("unit_id", F.explode("all").alias("a"), "all").select("unit_id", "a", F.explode("all").alias("b"))
    # not corr(), which fails on a series without spread
    r = F.when(F.count("*") >= LEAST_COMMON, F.try_divide(F.covar_samp("a.step", "b.step"), F.stddev_samp("a.step") * F.stddev_samp("b.step")))
    return pairs.groupBy("unit_id", F.col("a.asset").alias("asset_a"), F.col("b.asset").alias("asset_b")).agg(F.coalesce(r, F.lit(0.0)).alias("r")).select(
        "unit_id", "asset_a", "asset_b", F.when(F.col("asset_a") == F.col("asset_b"), 1.0).otherwise(F.col("r")).alias("corr")
    )


def _path(s: Column, t: Column, hurst: Column) -> Column:
    """Covariance of a fractional walk at two of its steps; an ordinary walk's is the lesser of them."""
    p = 2 * hurst
    return F.when(F.abs(hurst - 0.5) < 1e-12, F.least(s, t).cast("double")).otherwise(0.5 * (F.pow(s, p) + F.pow(t, p) - F.pow(F.abs(s - t), p)))


def moments(known: DataFrame, cells: DataFrame, cards: DataFrame, window: int = WINDOW, transfer: str = "geo") -> tuple[DataFrame, DataFrame]:
    """Cells and pairs of cells of all cards that the engine can forecast.

    known: rows of each card's series. cells: (unit_id, asset, horizon, months): steps ahead of a monthly card in months, else null.
    First (variant, unit_id, cell, asset, horizon, steps, mean, nu, mix_p, mix_m, corr_shrink), then (variant, unit_id, a, b,
    asset_a, asset_b, scale, corr): the covariance of two cells is scale * corr. A card with a series of fewer than LEAST_STEPS
    steps, or without spread, is left to the fallbacks."""
    stepped = steps(known, window)
    f = features(stepped, cards, window, transfer)
    able = f.groupBy(*CARD).agg(F.min((F.col("n_steps") >= LEAST_STEPS) & (F.coalesce(F.col("sd"), F.lit(0.0)) > 0) & ~F.isnan("sd")).alias("able"), F.max("transfer").alias("any_transfer"), F.count("*").alias("series"))
    monthly = F.col("kind") == "monthly"
    c = cells.join(f, ["unit_id", "asset"]).join(able.filter("able").drop("able"), CARD).join(cards.drop("as_of", "context_log_vol"), CARD)
    ahead = F.when(monthly, F.col("months")).otherwise(panel_steps_for(F.col("horizon"), F.col("spacing"))).cast("int")
    family = F.coalesce(F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv])[F.col("family")], F.lit(1.0))
    single = F.when((F.col("n_cells") == 1) & ~monthly, F.col("k_single")).otherwise(1.0)
    width = F.when(monthly, F.col("monthly_k")).otherwise(F.col("k")) * family * F.when(F.col("any_transfer"), F.col("transfer_k")).otherwise(1.0) * single
    drift = F.when(monthly, F.col("monthly_drift")).otherwise(F.col("drift"))
    nu = F.when(F.col("any_transfer"), F.col("transfer_nu")).when(monthly, F.col("monthly_nu")).otherwise(F.col("nu"))
    number = F.row_number().over(Window.partitionBy(*CARD).orderBy("asset", "horizon")) - 1
    c = c.withColumn("steps", ahead).select(
        *CARD, number.alias("cell"), "asset", "horizon", "steps", (F.col("last") + drift * F.col("mu") * F.col("steps")).alias("mean"), nu.alias("nu"), "mix_p", "mix_m", "corr_shrink",
        (F.col("sd") * width).alias("sd"), "hurst", "last",
    )
    side = lambda n: c.select(*CARD, F.col("cell").alias(n), F.col("asset").alias(f"asset_{n}"), F.col("steps").alias(f"s_{n}"), F.col("sd").alias(f"sd_{n}"), *(["hurst"] if n == "a" else []))
    pairs = side("a").join(side("b"), CARD).join(correlations(stepped, window), ["unit_id", "asset_a", "asset_b"], "left")
    scale = _path(F.col("s_a"), F.col("s_b"), F.col("hurst")) * F.col("sd_a") * F.col("sd_b")
    return c, pairs.select(*CARD, "a", "b", "asset_a", "asset_b", scale.alias("scale"), F.coalesce("corr", F.lit(0.0)).alias("corr"))


def walk_cells(known: DataFrame, cells: DataFrame) -> DataFrame:
    """(unit_id, asset, horizon, steps, anchor, spread) of all cells, whatever history there is: what the last rung of the ladder needs. Without
    rows the anchor is 0; without a spread it is a hundredth of the anchor."""
    stepped = steps(known)
    own = stepped.groupBy("unit_id", "asset").agg(
        F.max_by("value", "date").alias("newest"), F.first("kind").alias("kind"), F.stddev_pop(F.when(F.col("step_age") <= WINDOW, F.col("step"))).alias("spread"),
        F.avg(F.when(F.col("age") <= WINDOW, F.col("gap"))).alias("spacing"),
    )
    c = cells.join(own, ["unit_id", "asset"], "left")
    anchor = F.when(F.col("kind") == "returns", 0.0).otherwise(F.coalesce("newest", F.lit(0.0)))
    spread = F.when(F.col("spread") > 0, F.col("spread")).otherwise(F.greatest(F.abs(anchor) * 0.01, F.lit(1e-4)))
    ahead = F.coalesce("months", panel_steps_for(F.col("horizon"), F.coalesce("spacing", F.lit(1.4)))).cast("int")
    return c.select("unit_id", "asset", "horizon", F.greatest(ahead, F.lit(1)).alias("steps"), anchor.alias("anchor"), spread.alias("spread"))


def student_shocks(root: np.ndarray, n: int, nu: float, rng: np.random.Generator, mix_p: float = 0.0, mix_m: float = 1.0) -> np.ndarray:
    """n joint shocks of unit-variance Student margins with one common scale, times root; a share mix_p of them is mix_m times as wide."""
    z = rng.standard_normal((n, len(root)))
    common = rng.chisquare(nu, size=(n, 1)) / nu
    out = (z * np.sqrt((nu - 2.0) / nu / common)) @ root.T
    if mix_p > 0 and mix_m != 1:
        out[rng.random(n) < mix_p] *= mix_m
    return out


def shrunk(corr: np.ndarray, share: float) -> np.ndarray:
    """corr moved by share towards the matrix of its average correlation."""
    off = ~np.eye(len(corr), dtype=bool)
    if len(corr) < 2 or not share:
        return corr
    even = np.where(off, corr[off].mean(), 1.0)
    return nearest_correlation((1 - share) * corr + share * even)


def _engine(row, n: int) -> np.ndarray:
    cells, assets = row["cells"], sorted({c["asset"] for c in row["cells"]})
    at = {a: i for i, a in enumerate(assets)}
    d, corr = len(cells), np.eye(len(assets))
    scale = np.zeros((d, d))
    for p in row["pairs"]:
        scale[p["a"], p["b"]] = p["scale"]
        corr[at[p["asset_a"]], at[p["asset_b"]]] = p["corr"]
    corr = shrunk(nearest_correlation(corr), cells[0]["corr_shrink"]) if len(assets) > 1 else corr
    which = np.array([at[c["asset"]] for c in cells])
    cov = scale * corr[np.ix_(which, which)]
    root = factor(cov, 1e-9 * (np.diag(cov).mean() or 1.0))
    shocks = student_shocks(root, n, cells[0]["nu"], np.random.default_rng(seed_of(row["unit_id"])), cells[0]["mix_p"], cells[0]["mix_m"])
    return np.array([c["mean"] for c in cells]) + shocks


def _m0(row, n: int) -> np.ndarray:
    mean, cov = np.zeros(len(row["cells"])), np.zeros((len(row["cells"]),) * 2)
    for p in row["m0"]:
        mean[p["a"]], cov[p["a"], p["b"]] = p["mean_a"], p["cov"]
    rng = np.random.default_rng(seed_of(row["unit_id"]))
    return mean + rng.standard_normal((n, len(mean))) @ factor(cov + 1e-10 * np.eye(len(mean)), 1e-9).T


def _walk(row, n: int) -> np.ndarray:
    rng = np.random.default_rng(seed_of(row["unit_id"]))
    anchor, width = (np.array([w[c] for w in row["walk"]]) for c in ("anchor", "spread"))
    ahead = np.sqrt([w["steps"] for w in row["walk"]])
    return np.nan_to_num(anchor + rng.standard_normal((n, len(anchor))) * width * ahead * WALK_WIDTH)


RUNGS = (("engine", "pairs", _engine), ("m0", "m0", _m0), ("walk", "walk", _walk))


def draws(cells: DataFrame, pairs: DataFrame, walk: DataFrame, m0: DataFrame | None = None, n_draws: int = 1000) -> DataFrame:
    """Draws of every card of walk. The ladder: the engine where it has moments, then M0 (m0: (unit_id, a, b, mean_a, cov)), then the walk of
    each cell, which never fails; method tells the rung. One row a card reaches Python, its cells in order of (asset, horizon)."""
    listed = lambda df, name, *order: df.groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct(*order))).alias(name))
    place = ["asset", "horizon"]
    rows = listed(walk, "walk", *place, "steps", "anchor", "spread").join(listed(cells, "cells", *place, "mean", "nu", "mix_p", "mix_m", "corr_shrink"), "unit_id", "left")
    rows = rows.join(listed(pairs, "pairs", "a", "b", "asset_a", "asset_b", "scale", "corr"), "unit_id", "left")
    rows = rows.join(listed(m0, "m0", "a", "b", "mean_a", "cov"), "unit_id", "left") if m0 is not None else rows.withColumn("m0", F.lit(None).cast("array<struct<a:int,b:int,mean_a:double,cov:double>>"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                where, d = row["walk"], len(row["walk"])
                for name, needs, rung in RUNGS:
                    if row[needs] is None or (needs != "walk" and (row["cells"] is None and needs == "pairs" or len(row[needs]) != d * d)):
                        continue
                    try:
                        x = rung(row | {"cells": where if row["cells"] is None else row["cells"]}, n_draws)
                    except (np.linalg.LinAlgError, ValueError, FloatingPointError):
                        continue
                    if np.isfinite(x).all():
                        out.append(pd.DataFrame({"unit_id": row["unit_id"], "draw": np.repeat(np.arange(n_draws), d), "asset": [w["asset"] for w in where] * n_draws, "horizon": [w["horizon"] for w in where] * n_draws, "value": x.ravel(), "method": name}))
                        break
            yield pd.concat(out) if out else no_draws()

    return rows.mapInPandas(run, DRAWS)
