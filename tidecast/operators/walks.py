"""More forecasters for the grouped sampler: the reference walk, monthly walks, blended-volatility walks and a GARCH fit."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .asof import newest_as_of
from .forecast import DRAWS, factor, nearest_correlation, no_draws, seed_of


def walk(history: np.ndarray, steps: list[int], n: int, key: str, log_return: bool = False) -> np.ndarray:
    """Joint Gaussian walk of all series (rows: dates, columns: series): driftless levels, or returns with drift. [n, series, horizons]"""
    x = np.log1p(history[:, :]) if log_return else np.diff(history, axis=0)
    rng = np.random.default_rng(seed_of(key))
    sd = x.std(axis=0, ddof=1)
    shape = nearest_correlation(np.atleast_2d(np.corrcoef(x, rowvar=False)) if x.shape[1] > 1 else np.ones((1, 1)))
    root = factor(shape * np.outer(sd, sd), 1e-12)
    path = np.cumsum(rng.standard_normal((n, max(steps), x.shape[1])) @ root.T + (x.mean(axis=0) if log_return else 0.0), axis=1)
    at = path[:, np.array(steps) - 1, :].transpose(0, 2, 1)
    return at if log_return else history[-1][None, :, None] + at


def monthly_walk(history: np.ndarray, steps: np.ndarray, n: int, key: str) -> np.ndarray:
    """Walks that share each calendar month's innovations; steps: months ahead by series and horizon, read off the same paths."""
    x = np.diff(history, axis=0)
    rng = np.random.default_rng(seed_of(key))
    root = factor(np.atleast_2d(np.cov(x, rowvar=False)), 1e-12)
    path = np.cumsum(rng.standard_normal((n, int(steps.max()), history.shape[1])) @ root.T + x.mean(axis=0), axis=1)
    return np.stack([history[-1][a] + path[:, steps[a] - 1, a] for a in range(history.shape[1])], axis=1)


def blended_walk(history: np.ndarray, steps: list[int], n: int, key: str, decay: float = 0.94, weight: float = 0.5, nu: float = 6.0, drift: float = 0.5) -> np.ndarray:
    """A Student walk whose variance blends an exponential average of recent squares with the long run's."""
    x = np.diff(history, axis=0)
    w = decay ** np.arange(len(x))[::-1]
    sd = np.sqrt(weight * (w @ x**2) / w.sum() + (1 - weight) * x.var(axis=0, ddof=1))
    rng = np.random.default_rng(seed_of(key))
    z = rng.standard_normal((n, x.shape[1], len(steps))) / np.sqrt(rng.chisquare(nu, (n, 1, 1)) / nu) * np.sqrt((nu - 2) / nu)
    s = np.array(steps)
    return history[-1][None, :, None] + drift * x.mean(axis=0)[None, :, None] * s + z * sd[None, :, None] * np.sqrt(s)


def garch(x: np.ndarray, sweeps: int = 60) -> tuple[float, float, float]:
    """(omega, alpha, beta) of a GARCH(1,1), by likelihood on a grid that shrinks about its best point; variance is targeted."""
    x = x - x.mean()
    v = x.var()

    def loss(alpha: float, beta: float) -> float:
        if not (0 <= alpha < 1 and 0 <= beta < 1 and alpha + beta < 0.999):
            return np.inf
        h, total = v, 0.0
        for e in x:
            total += np.log(h) + e * e / h
            h = v * (1 - alpha - beta) + alpha * e * e + beta * h
        return total

    best, width = (0.05, 0.9), np.array([0.05, 0.08])
    least = loss(*best)
    for _ in range(sweeps // 6):
        for da in (-1, 0, 1):
            for db in (-1, 0, 1):
                p = (best[0] + da * width[0], best[1] + db * width[1])
                if (value := loss(*p)) < least:
                    best, least = p, value
        width = width * 0.6
    return v * (1 - sum(best)), *best


def garch_walk(history: np.ndarray, steps: list[int], n: int, key: str) -> np.ndarray:
    """Each series by itself: steps about a first-order autoregression, their variance a GARCH(1,1) that goes on from the last step's."""
    rng, out = np.random.default_rng(seed_of(key)), np.empty((n, history.shape[1], len(steps)))
    for a, level in enumerate(history.T):
        x = np.diff(level)
        mean = x.mean()
        before, after = x[:-1] - mean, x[1:] - mean
        phi = float(np.clip(before @ after / max(before @ before, 1e-300), -0.95, 0.95))
        e = np.append(x[0] - mean, after - phi * before)
        omega, alpha, beta = garch(e)
        h = e.var()
        for shock in e:  # to the variance of the step to come
            h = omega + alpha * shock * shock + beta * h
        variance, step, path = np.full(n, h), np.full(n, x[-1] - mean), np.zeros((n, max(steps)))
        for k in range(max(steps)):
            shock = np.sqrt(variance) * rng.standard_normal(n)
            step, variance = phi * step + shock, omega + alpha * shock * shock + beta * variance
            path[:, k] = mean + step
        out[:, a] = level[-1] + np.cumsum(path, axis=1)[:, np.array(steps) - 1]
    return out


def segment_walk(history: np.ndarray, steps: list[int], n: int, key: str, recent: float = 0.5, half_life: float = 21.0, revert: float = 63.0, drift: float = 0.5, tau: float = 0.2) -> np.ndarray:
    """Joint walks that are drawn once for each stretch between two horizons. A step's variance goes from a blend of its recent and long-run
    values to the long-run one with half-life revert; all of a draw is scaled by a log-normal number of mean square 1."""
    x = np.diff(history, axis=0)
    weight = 0.5 ** (np.arange(len(x))[::-1] / half_life)
    long = x.var(axis=0)
    now = recent * (weight @ x**2) / weight.sum() + (1 - recent) * long
    phi = 0.5 ** (1 / revert)
    until = lambda s: s * long + (now - long) * phi * (1 - phi**s) / (1 - phi)  # noqa: E731  variance of the first s steps
    rng = np.random.default_rng(seed_of(key))
    scale = np.exp(tau * rng.standard_normal(n) - tau * tau)
    shape = nearest_correlation(np.atleast_2d(np.corrcoef(x, rowvar=False)) if x.shape[1] > 1 else np.ones((1, 1)))
    root, out, path, before = factor(shape, 1e-12), np.empty((n, x.shape[1], len(steps))), np.zeros((n, x.shape[1])), 0
    for s in sorted(set(steps)):
        stretch = np.maximum(until(s) - until(before), 0.0)
        path, before = path + (rng.standard_normal(path.shape) @ root.T) * np.sqrt(stretch), s
        for i in np.flatnonzero(np.array(steps) == s):
            out[:, :, i] = history[-1] + drift * s * x.mean(axis=0) + scale[:, None] * path
    return out


def forecast(histories: DataFrame, forecaster: Callable[[np.ndarray, list[int], int, str], np.ndarray], n_draws: int = 500) -> DataFrame:
    """Draws of any forecaster for histories (unit_id, asset, date, value, horizons): a card's dates that all its assets have, in one group."""

    def run(card: pd.DataFrame) -> pd.DataFrame:
        wide = card.pivot_table(index="date", columns="asset", values="value", aggfunc="last").dropna().sort_index()
        if len(wide) < 3:  # too short for a step's spread: the card has no draws
            return no_draws()
        steps = sorted(int(h) for h in card.horizons.iloc[0])
        x = forecaster(wide.to_numpy(float), steps, n_draws, card.unit_id.iloc[0])
        index = pd.MultiIndex.from_product([range(n_draws), wide.columns, steps], names=["draw", "asset", "horizon"])
        out = pd.DataFrame({"value": x.ravel()}, index=index).reset_index()
        return out.assign(unit_id=card.unit_id.iloc[0], method=getattr(forecaster, "__name__", "forecaster"))[[f.name for f in DRAWS]]

    return histories.groupBy("unit_id").applyInPandas(run, DRAWS)


def with_client(rows: DataFrame, prompt: str, connect: Callable[[], Callable[[str], str]], budget: int = 14, seconds: float = 240.0, failures: int = 3, out: str = "answer") -> DataFrame:
    """rows with the answers of a remote model: one client for each task, which stops at its budget of requests, its deadline or after so
    many failures in a row; from then on answers are null. connect makes the client on the executor; there is none offline."""
    import time

    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())])

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, used, failed, began = connect(), 0, 0, time.monotonic()
        for batch in batches:
            answers = []
            for text in batch[prompt]:
                answer = None
                if used < budget and failed < failures and time.monotonic() - began < seconds:
                    used += 1
                    try:
                        answer, failed = client(text), 0
                    except OSError:
                        failed += 1
                answers.append(answer)
            yield batch.assign(**{out: answers})

    return rows.mapInPandas(ask, schema)


def newest_rows(panel: DataFrame, cards: DataFrame, n: int = 300) -> DataFrame:
    """(unit_id, asset, date, value, horizons) of the newest n rows of each card's assets as of its date; cards: (unit_id, as_of, asset, horizons)."""
    return newest_as_of(cards, panel, n, ["asset"]).select("unit_id", "asset", "date", "value", "horizons")
