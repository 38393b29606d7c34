"""Proper scores of draws (draw, cell, value) against an outcome (cell, y), and what they are put together to.

All functions take keys, the columns that tell one forecast from another, so one pass scores every forecast of a table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The tail levels, and the weights of the marginal, joint and tail parts.
TAIL_LEVELS = (0.01, 0.05, 0.95, 0.99)
WEIGHTS = (0.5, 0.3, 0.2)


def crps(draws: DataFrame, outcome: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """(keys, cell, crps): from the sorted draws, mean |x - y| less half the mean distance of two draws."""
    w = Window.partitionBy(*keys, "cell")
    r = draws.join(outcome, [*[k for k in keys if k in outcome.columns], "cell"])
    r = r.withColumn("rank", F.row_number().over(w.orderBy("value", "draw"))).withColumn("m", F.count("*").over(w))
    spread = F.sum((2 * F.col("rank") - F.col("m") - 1) * F.col("value")) / (F.max("m") * F.max("m"))
    return r.groupBy(*keys, "cell").agg((F.avg(F.abs(F.col("value") - F.col("y"))) - spread).alias("crps"))


def variogram(draws: DataFrame, outcome: DataFrame, keys: list[str] = [], p: float = 0.5) -> DataFrame:  # noqa: B006
    """(keys, variogram): sum over cell pairs of (|ya - yb|^p - mean |xa - xb|^p)^2. Cells of a draw meet in an array, so no join by draw."""
    vectors = draws.groupBy(*keys, "draw").agg(F.array_sort(F.collect_list(F.struct("cell", "value"))).alias("v"))
    pairs = vectors.select(*keys, F.explode(_pairs("v", "value")).alias("q")).select(*keys, "q.*")
    mean = pairs.groupBy(*keys, "a", "b").agg(F.avg(F.pow(F.col("gap"), F.lit(p))).alias("e"))
    ykeys = [k for k in keys if k in outcome.columns]
    y = outcome.groupBy(*ykeys).agg(F.array_sort(F.collect_list(F.struct("cell", "y"))).alias("v")).select(*ykeys, F.explode(_pairs("v", "y")).alias("q")).select(*ykeys, "q.*")
    both = mean.join(y.withColumnRenamed("gap", "ygap"), [*ykeys, "a", "b"])
    return both.groupBy(*keys).agg(F.sum(F.pow(F.pow(F.col("ygap"), F.lit(p)) - F.col("e"), F.lit(2.0))).alias("variogram"))


def _pairs(array: str, value: str) -> Column:
    """(a, b, gap) of the cells a < b of an array of (cell, value)."""
    return F.flatten(F.transform(array, lambda x: F.transform(F.filter(array, lambda z: z["cell"] > x["cell"]), lambda z: F.struct(x["cell"].alias("a"), z["cell"].alias("b"), F.abs(x[value] - z[value]).alias("gap")))))


def energy(draws: DataFrame, outcome: DataFrame, keys: list[str] = [], block: int = 512) -> DataFrame:  # noqa: B006
    """(keys, energy): mean |X - y| less half the mean |X - X'| over vectors. All pairs of a forecast's draws count by definition; they meet
    as pairs of blocks of about `block` draws, a row each, whose distances are found by matrix products. Linear in forecasts."""
    vectors = draws.groupBy(*keys, "draw").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "value"))), lambda s: s["value"]).alias("v"))
    sized = vectors.join(vectors.groupBy(*keys).agg(F.count("*").alias("m")), keys) if keys else vectors.crossJoin(vectors.agg(F.count("*").alias("m")))
    dealt = sized.withColumn("block", F.pmod(F.xxhash64("draw"), F.ceil(F.col("m") / block).cast("long")))
    blocks = dealt.groupBy(*keys, "m", "block").agg(F.collect_list("v").alias("vs"))
    y = outcome.agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "y"))), lambda s: s["y"]).alias("y"))

    @F.pandas_udf(T.DoubleType())
    def distances(a: pd.Series, b: pd.Series) -> pd.Series:
        """Sum of the distances of each vector of a to each of b."""
        out = []
        for p, q in zip(a, b, strict=True):
            p, q = np.stack([np.asarray(x, float) for x in p]), np.stack([np.asarray(x, float) for x in q])
            square = (p * p).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * p @ q.T
            near = np.argwhere(square < 1e-6 * ((p * p).sum(1)[:, None] + 1e-300))  # where the difference of squares says little
            square[near[:, 0], near[:, 1]] = ((p[near[:, 0]] - q[near[:, 1]]) ** 2).sum(1)
            out.append(float(np.sqrt(np.maximum(square, 0)).sum()))
        return pd.Series(out)

    own = blocks.crossJoin(F.broadcast(y)).groupBy(*keys, "m").agg(F.sum(distances("vs", F.array("y"))).alias("to_y"))  # y is one row
    other = blocks.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("block").alias("__block"), F.col("vs").alias("__vs"))
    on = [F.col(k) == F.col(f"__{k}") for k in keys] + [F.col("block") <= F.col("__block")]
    twice = F.when(F.col("block") == F.col("__block"), 1.0).otherwise(2.0)
    among = blocks.join(other, on).groupBy(*keys).agg(F.sum(twice * distances("vs", "__vs")).alias("among"))
    joined = own.join(among, keys) if keys else own.crossJoin(among)
    return joined.select(*keys, (F.col("to_y") / F.col("m") - F.col("among") / (2 * F.col("m") * F.col("m"))).alias("energy"))


def quantiles(draws: DataFrame, keys: list[str], levels=TAIL_LEVELS) -> DataFrame:
    """(keys, level, q): exact quantiles, linear between draws."""
    q = draws.groupBy(*keys).agg(F.expr(f"percentile(value, array({', '.join(f'{x}D' for x in levels)}))").alias("qs"))
    return q.select(*keys, F.explode(F.arrays_zip(F.array(*map(F.lit, levels)).alias("level"), F.col("qs").alias("q"))).alias("z")).select(*keys, "z.level", "z.q")


def pinball(draws: DataFrame, outcome: DataFrame, keys: list[str] = [], levels=TAIL_LEVELS) -> DataFrame:  # noqa: B006
    """(keys, pinball): mean quantile loss over levels and cells."""
    q = quantiles(draws, [*keys, "cell"], levels).join(outcome, [*[k for k in keys if k in outcome.columns], "cell"])
    loss = F.when(F.col("y") >= F.col("q"), F.col("level") * (F.col("y") - F.col("q"))).otherwise((1 - F.col("level")) * (F.col("q") - F.col("y")))
    return q.groupBy(*keys).agg(F.avg(loss).alias("pinball"))


def coverage(draws: DataFrame, outcome: DataFrame, keys: list[str] = [], levels=TAIL_LEVELS) -> DataFrame:  # noqa: B006
    """(keys, coverage): sum over levels of |share of cells at or below the quantile - level|."""
    q = quantiles(draws, [*keys, "cell"], levels).join(outcome, [*[k for k in keys if k in outcome.columns], "cell"])
    by_level = q.groupBy(*keys, "level").agg(F.avg((F.col("y") <= F.col("q")).cast("double")).alias("share"))
    return by_level.groupBy(*keys).agg(F.sum(F.abs(F.col("share") - F.col("level"))).alias("coverage"))


#: By name; an unknown name is a KeyError, not a fallback.
TAIL_METRICS = {"pinball": pinball, "coverage": coverage}
JOINT_METRICS = {"variogram": variogram, "energy": energy}


def components(draws: DataFrame, outcome: DataFrame, keys: list[str] = [], joint: str = "variogram", tail: str = "pinball") -> DataFrame:  # noqa: B006
    """(keys, cells, marginal, joint, tail)."""
    m = crps(draws, outcome, keys).groupBy(*keys).agg(F.avg("crps").alias("marginal"), F.count("*").alias("cells"))
    j = JOINT_METRICS[joint](draws, outcome, keys).withColumnRenamed(joint, "joint")
    t = TAIL_METRICS[tail](draws, outcome, keys).withColumnRenamed(tail, "tail")
    if not keys:
        return m.crossJoin(j).crossJoin(t)
    return m.join(j, keys, "left").join(t, keys).withColumn("joint", F.coalesce("joint", F.lit(0.0)))


def composite(marginal: Column, joint: Column, tail: Column, cells: Column, weights=WEIGHTS) -> Column:
    """Weighted sum of the parts' ratios; a single cell has no joint part and its weight goes to the others."""
    a, b, c = weights
    return F.when(cells == 1, (a * marginal + c * tail) / (a + c)).otherwise(a * marginal + b * joint + c * tail)
