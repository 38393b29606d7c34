"""Forecast generation: moments in SQL, draws in one grouped pandas function for each card, overlays as projections.

A card's cells are its assets by its horizons. Cell means and the covariance of each pair of cells come from the moments of the
assets' steps; only these few numbers for each card reach Python, which factors the matrix and draws."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Parameters of the engine, and what changes for cards of several cells.
DEFAULTS = {"drift": 0.5, "nu": 8.0, "k": 1.0, "beta": 0.5, "mix_p": 0.0, "mix_m": 1.0, "hurst": 0.5}
MULTI = {"drift": 0.9, "nu": 8.0, "k": 1.05, "beta": 0.0}
MIN_DRAWS = 500
#: The text overlay's shift per unit of probability, its bound, and the lexicon model.
SHIFT_PER_UNIT, SHIFT_CAP = 0.25, 0.1

DRAWS = T.StructType([T.StructField("unit_id", T.StringType()), T.StructField("draw", T.IntegerType()), T.StructField("asset", T.StringType()), T.StructField("horizon", T.IntegerType()), T.StructField("value", T.DoubleType()), T.StructField("method", T.StringType())])


def no_draws() -> pd.DataFrame:
    kinds = {"draw": "int32", "horizon": "int32", "value": "float64"}
    return pd.DataFrame({f.name: pd.Series([], dtype=kinds.get(f.name, "str")) for f in DRAWS})


def seed_of(unit_id: str) -> int:
    return zlib.crc32(unit_id.encode()) & 0x7FFFFFFF


def seed(unit_id: Column) -> Column:
    """The same in SQL."""
    return F.crc32(unit_id.cast("binary")).bitwiseAND(F.lit(0x7FFFFFFF))


def aligned_steps(steps: DataFrame, keys: list[str], n_assets: int) -> DataFrame:
    """Steps of the dates on which all n_assets have one: the inner alignment of all series."""
    w = Window.partitionBy(*keys, "date")
    return steps.withColumn("__n", F.count("*").over(w)).filter(F.col("__n") == n_assets).drop("__n")


def moments(steps: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keys, asset, mu) and (keys, asset_a, asset_b, cov) of aligned steps."""
    mu = steps.groupBy(*keys, "asset").agg(F.avg("step").alias("mu"))
    side = lambda n, v: steps.select(*keys, "date", F.col("asset").alias(f"asset_{n}"), F.col("step").alias(v))
    cov = side("a", "x").join(side("b", "y"), [*keys, "date"]).groupBy(*keys, "asset_a", "asset_b").agg(F.covar_samp("x", "y").alias("cov"))
    return mu, cov


def cell_moments(cells: DataFrame, mu: DataFrame, cov: DataFrame, keys: list[str], drift: float = 1.0, width: float = 1.0) -> DataFrame:
    """(keys, a, b, mean_a, cov): for each pair of a card's cells (keys, cell, asset, steps, anchor): mean anchor + drift * steps * mu, and
    width squared times the lesser number of steps times the assets' covariance."""
    c = cells.join(mu, [*keys, "asset"]).withColumn("mean", F.col("anchor") + drift * F.col("steps") * F.col("mu"))
    a = c.select(*keys, F.col("cell").alias("a"), F.col("asset").alias("asset_a"), F.col("steps").alias("sa"), F.col("mean").alias("mean_a"))
    b = c.select(*keys, F.col("cell").alias("b"), F.col("asset").alias("asset_b"), F.col("steps").alias("sb"))
    pairs = a.join(b, keys).join(cov, [*keys, "asset_a", "asset_b"])
    return pairs.select(*keys, "a", "b", "mean_a", (F.least("sa", "sb") * F.col("cov") * width * width).alias("cov"))


def nearest_correlation(c: np.ndarray, floor: float = 1e-6) -> np.ndarray:
    """A correlation matrix without negative eigenvalues; missing entries count as 0."""
    c = np.where(np.isfinite(c), c, 0.0)
    np.fill_diagonal(c, 1.0)
    w, v = np.linalg.eigh((c + c.T) / 2)
    c = (v * np.maximum(w, floor)) @ v.T
    s = 1 / np.sqrt(np.diag(c))
    return c * s[:, None] * s[None, :]


def factor(cov: np.ndarray, jitter: float) -> np.ndarray:
    """A Cholesky factor of cov with jitter on its diagonal; roots of the diagonal where there is none."""
    try:
        return np.linalg.cholesky(cov + jitter * np.eye(len(cov)))
    except np.linalg.LinAlgError:
        return np.diag(np.sqrt(np.maximum(np.diag(cov), 0.0) + 1e-12))


def gaussian(mean: np.ndarray, cov: np.ndarray, n: int, key: str) -> np.ndarray:
    rng = np.random.default_rng(seed_of(key))
    return mean + rng.standard_normal((n, len(mean))) @ factor(cov + 1e-10 * np.eye(len(mean)), 1e-9).T


def student(mean: np.ndarray, cov: np.ndarray, n: int, key: str, nu: float, mix_p: float = 0.0, mix_m: float = 1.0) -> np.ndarray:
    """Draws with unit-variance Student shocks that share one scale a draw, and with probability mix_p a multiplier mix_m."""
    rng = np.random.default_rng(seed_of(key))
    z = rng.standard_normal((n, len(mean)))
    scale = np.sqrt(rng.chisquare(nu, size=(n, 1)) / nu)
    shocks = (z / scale * np.sqrt((nu - 2) / nu)) @ factor(cov, 1e-9 * (np.diag(cov).mean() or 1.0)).T
    if mix_p > 0 and mix_m != 1:
        shocks = shocks * np.where(rng.random((n, 1)) < mix_p, mix_m, 1.0)
    return mean + shocks


def sample(pairs: DataFrame, cells: DataFrame, n_draws: int = MIN_DRAWS, method: str = "m0", nu: float = DEFAULTS["nu"], mix_p: float = 0.0, mix_m: float = 1.0) -> DataFrame:
    """Draws of every card from its cell moments, long. The ladder: the asked-for method, then Gaussian, then independent cells;
    method tells which rung gave the draws. One exchange, by card."""
    names = cells.groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("cell", "asset", "horizon"))).alias("cells"))
    matrix = pairs.groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("a", "b", "mean_a", "cov"))).alias("pairs"))

    def draw(card: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in card.itertuples():
            d = len(row.cells)
            mean, cov = np.zeros(d), np.full((d, d), np.nan)
            for p in row.pairs:
                mean[p["a"]], cov[p["a"], p["b"]] = p["mean_a"], p["cov"]
            rungs = [("independent", lambda: gaussian(mean, np.diag(np.nan_to_num(np.diag(cov))), n_draws, row.unit_id))]
            if np.isfinite(cov).all():
                rungs.insert(0, ("m0", lambda: gaussian(mean, cov, n_draws, row.unit_id)))
                if method == "student":
                    rungs.insert(0, ("student", lambda: student(mean, cov, n_draws, row.unit_id, nu, mix_p, mix_m)))
            for name, rung in rungs:
                try:
                    x = rung()
                except (np.linalg.LinAlgError, ValueError):
                    continue
                if np.isfinite(x).all():
                    out.append(pd.DataFrame({"unit_id": row.unit_id, "draw": np.repeat(np.arange(n_draws), d), "asset": [c["asset"] for c in row.cells] * n_draws, "horizon": [c["horizon"] for c in row.cells] * n_draws, "value": x.ravel(), "method": name}))
                    break
        return pd.concat(out) if out else no_draws()

    return names.join(matrix, "unit_id").mapInPandas(lambda batches: (draw(b) for b in batches), DRAWS)


def shift_by_probability(p: Column) -> Column:
    """Shift in standard deviations for a probability of a rise."""
    return F.least(F.greatest(SHIFT_PER_UNIT * (2 * p - 1), F.lit(-SHIFT_CAP)), F.lit(SHIFT_CAP))


def overlay(draws: DataFrame, shift: Column, keys: list[str]) -> DataFrame:
    """draws moved by shift times the population sd of their cell."""
    return draws.withColumn("value", F.col("value") + shift * F.stddev_pop("value").over(Window.partitionBy(*keys)))


def widen(draws: DataFrame, factor_: Column, keys: list[str], shift: float = 0.0) -> DataFrame:
    """draws stretched about their cell's median, then moved by shift sds."""
    w = Window.partitionBy(*keys)
    mid = F.median("value").over(w)
    return draws.withColumn("value", mid + (F.col("value") - mid) * factor_ + shift * F.stddev_pop("value").over(w))


def random_number_transform(draws: DataFrame, keys: list[str], drift: float, width: float) -> DataFrame:
    """The same random numbers under another drift and width: mean * drift + deviation * width, about each cell's anchor."""
    mean = F.avg("value").over(Window.partitionBy(*keys))
    return draws.withColumn("value", F.col("anchor") + drift * (mean - F.col("anchor")) + width * (F.col("value") - mean))
