"""Bootstrap, permutation, rank and model-selection statistics with a hashed random number generator.

The generator makes a uniform number of a text key, the same in any engine, so resampling has an exact oracle and no seed state."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the parts' text."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


BUCKET_ROWS, MOST_BUCKETS = 100_000, 1024
POISSON_MOST = 12  # a Poisson(1) number is larger once in 10 ** 10


def _dealt(row: Column, cuts: list, low: int, high: int) -> Column:
    """How many of cuts[low:high] lie below row, plus low, in as many comparisons as the number has bits."""
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    cut = F.struct(*[F.lit(v).alias(n) for n, v in cuts[mid].asDict().items()])
    return F.when(row > cut, _dealt(row, cuts, mid + 1, high)).otherwise(_dealt(row, cuts, low, mid))


def numbered(df: DataFrame, order: list[str], out: str = "rn") -> DataFrame:
    """df with its row number, from 1, in the order of all rows; no task sorts all of them. Cuts from a sample by hash deal the rows into
    buckets of about BUCKET_ROWS rows, each sorted by itself; the counts of the buckets before are added. A cut is a value of all order
    columns, so rows that tie in the first are dealt by the next."""
    key = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    keyed = df.withColumn("__k", key)
    n = df.count()
    buckets = min(MOST_BUCKETS, max(1, n // BUCKET_ROWS + 1))
    cuts = []
    if buckets > 1:
        sample = keyed.select("__k").orderBy(F.xxhash64("__k"), "__k").limit(16 * buckets).orderBy("__k").collect()  # of a fixed size
        cuts = [r[0] for r in sample[16::16]]
    rows = keyed.withColumn("__b", _dealt(F.col("__k"), cuts, 0, len(cuts)))
    counts = rows.groupBy("__b").agg(F.count("*").alias("n"))
    before = counts.withColumn("__before", F.sum("n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))).select("__b", F.coalesce("__before", F.lit(0)).alias("__before"))
    rows = rows.withColumn(out, F.row_number().over(Window.partitionBy("__b").orderBy(*order)))
    return rows.join(F.broadcast(before), "__b").withColumn(out, F.col(out) + F.col("__before")).drop("__b", "__before", "__k")  # a row a bucket


def cluster_bootstrap(rows: DataFrame, cluster: str, value: str, replicates: int = 200, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """(keys, mean, low, high): mean with its 2.5 and 97.5 % bootstrap bounds; whole clusters are drawn. Rows are summed by cluster
    once, and the replicates draw from these sums."""
    sums = rows.groupBy(*keys, cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    if keys:
        turns = sums.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(cluster)) - 1).withColumn("m", F.count("*").over(Window.partitionBy(*keys)))
    else:
        turns = numbered(sums, [cluster], "k").withColumn("k", F.col("k") - 1).crossJoin(F.broadcast(sums.agg(F.count("*").alias("m"))))
    draws = turns.select(*keys, F.col("k").alias("turn"), "m").withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    draws = draws.withColumn("k", F.floor(uniform(F.col("b"), F.col("turn")) * F.col("m")).cast("long"))
    means = draws.drop("m").join(turns.select(*keys, "k", "s", "n"), [*keys, "k"]).groupBy(*keys, "b").agg((F.sum("s") / F.sum("n")).alias("x"))
    bounds = means.groupBy(*keys).agg(F.expr("percentile(x, array(0.025D, 0.975D))").alias("q"))
    whole = sums.groupBy(*keys).agg((F.sum("s") / F.sum("n")).alias("mean"))
    both = whole.join(bounds, keys) if keys else whole.crossJoin(bounds)
    return both.select(*keys, "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def row_bootstrap(rows: DataFrame, value: str, key: str, replicates: int = 200) -> DataFrame:
    """(mean, low, high): mean with its 2.5 and 97.5 % bootstrap bounds, rows being drawn one by one: in each replicate a row counts as often as
    a Poisson number of its hash says. One pass, whose sums by replicate are made before the exchange; no row is joined or sorted."""
    each = rows.select(F.col(value).alias("v"), F.col(key).alias("k")).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    u = uniform(F.col("b"), F.col("k"))
    times, total = F.lit(0), 0.0
    for n in range(POISSON_MOST):  # the number of steps of the distribution below u
        total += math.exp(-1) / math.factorial(n)
        times = times + (u >= total).cast("int")
    means = each.withColumn("w", times).groupBy("b").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("x"))
    bounds = means.agg(F.expr("percentile(x, array(0.025D, 0.975D))").alias("q"))
    return rows.agg(F.avg(value).alias("mean")).crossJoin(bounds).select("mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))  # a row each


def with_average_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """df with the rank of value from 1; ties share the mean of their ranks. Values are counted first, so ties, however many, are one row when
    they are ranked; a null has none."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    placed = numbered(counts, ["__v"], "__i")
    # the running total over numbered values: by blocks of positions, then within them
    block = placed.withColumn("__q", F.floor((F.col("__i") - 1) / BUCKET_ROWS))
    before = block.groupBy("__q").agg(F.sum("__n").alias("__s")).withColumn("__before", F.sum("__s").over(Window.orderBy("__q").rowsBetween(Window.unboundedPreceding, -1))).select("__q", F.coalesce("__before", F.lit(0)).alias("__before"))
    within = F.coalesce(F.sum("__n").over(Window.partitionBy("__q").orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = block.withColumn("__r", within).join(F.broadcast(before), "__q").select("__v", (F.col("__before") + F.col("__r") + (F.col("__n") + 1) / 2).alias(out))  # a row a block
    return df.join(ranks, F.col(value) == F.col("__v"), "left").drop("__v")


def spearman(rows: DataFrame, x: str, y: str, z: str | None = None) -> DataFrame:
    """(rho, partial): rank correlation of x and y, and the same with z held fixed."""
    r = rows.select(F.col(x).alias("x"), F.col(y).alias("y"), F.col(z or x).alias("z"))
    for c in "xyz":
        r = with_average_rank(r, c, f"r{c}")
    c = r.agg(F.corr("rx", "ry").alias("xy"), F.corr("rx", "rz").alias("xz"), F.corr("ry", "rz").alias("yz"))
    partial = (F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt((1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz")))
    return c.select(F.col("xy").alias("rho"), (partial if z else F.lit(None).cast("double")).alias("partial"))


def permutation_test(rows: DataFrame, x: str, y: str, group: str, key: str, replicates: int = 99) -> DataFrame:
    """(observed, exceed, p): how many shuffles of y within groups reach the correlation of x and y; p = (exceed + 1) / (replicates + 1)."""
    base = rows.select(x, y, group, key)
    size = F.count("*").over(Window.partitionBy(group))
    sides = base.withColumn("m", size).select(group, key, "m", F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col(x).alias("v")), F.struct(F.lit(1).alias("side"), F.col(y).alias("v")))))
    many = sides.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    # x in the order of keys, behind them y in a shuffled one: one sort of each replicate's group pairs them, in one exchange
    line = Window.partitionBy("b", group).orderBy("side", F.when(F.col("side") == 1, uniform(F.col("b"), F.col(key))), key)
    placed = many.withColumn("place", F.row_number().over(line) - F.col("side") * F.col("m"))
    met = placed.groupBy("b", group, "place").agg(F.max(F.when(F.col("side") == 0, F.col("v"))).alias("x"), F.max(F.when(F.col("side") == 1, F.col("v"))).alias("y"))
    each = met.groupBy("b").agg(F.corr("x", "y").alias("r"))
    seen = base.agg(F.corr(x, y).alias("observed"))
    n = each.crossJoin(F.broadcast(seen)).groupBy("observed").agg(F.count_if(F.abs("r") >= F.abs("observed")).alias("exceed"))
    return n.withColumn("p", (F.col("exceed") + 1) / F.lit(replicates + 1.0))


def holm(tests: DataFrame, p: str, key: str) -> DataFrame:
    """tests with adjusted: step-down p values. One row a hypothesis, so one small window."""
    w = Window.orderBy(p, key)
    scaled = F.least(F.lit(1.0), (F.count("*").over(Window.partitionBy()) - F.row_number().over(w) + 1) * F.col(p))
    return tests.withColumn("__s", scaled).withColumn("adjusted", F.max("__s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__s")


def auc(rows: DataFrame, score: str, label: str, key: str) -> DataFrame:
    """(auc): by ranks, ties broken by key."""
    r = numbered(rows, [score, key], "r")
    n1 = F.sum(F.when(F.col(label) == 1, 1).otherwise(0))
    n0 = F.count("*") - n1
    return r.agg(F.try_divide(F.sum(F.when(F.col(label) == 1, F.col("r"))) - n1 * (n1 + 1) / 2, n1 * n0).alias("auc"))  # null with one label only


def logistic(rows: DataFrame, features: list[str], label: str, c: float = 0.3, steps: int = 50) -> dict:
    """Ridge logistic regression by Newton steps on standardised features; each step is one aggregation of the k * k normal
    equations over all rows. Population sd, penalty 1 / (2c) on all but the intercept."""
    k = len(features)
    rows = rows.select(*features, label).persist()  # read in each step; lost parts are found again from the lineage
    m = rows.agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)], *[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features)]).first()
    if k and m["m0"] is None:  # no rows: a model that says one half
        return {"mean": [0.0] * k, "scale": [1.0] * k, "intercept": 0.0, "weights": [0.0] * k}
    mean, scale = [m[f"m{i}"] for i in range(k)], [m[f"s{i}"] + 1e-9 for i in range(k)]
    x = [F.lit(1.0)] + [(F.col(f) - mean[i]) / scale[i] for i, f in enumerate(features)]
    w = np.zeros(k + 1)
    penalty = np.diag([0.0] + [1 / c] * k)
    for _ in range(steps):
        p = 1 / (1 + F.exp(-sum((F.lit(float(w[i])) * x[i] for i in range(k + 1)), F.lit(0.0))))
        r = rows.select(p.alias("p"), F.col(label).cast("double").alias("y"), *[v.alias(f"x{i}") for i, v in enumerate(x)])
        v = F.col("p") * (1 - F.col("p"))
        sums = r.agg(*[F.sum((F.col("p") - F.col("y")) * F.col(f"x{i}")).alias(f"g{i}") for i in range(k + 1)], *[F.sum(v * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]).first()
        g = np.array([sums[f"g{i}"] for i in range(k + 1)]) + penalty @ w
        h = np.array([[sums[f"h{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)]) + penalty
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    rows.unpersist()
    return {"mean": mean, "scale": scale, "intercept": float(w[0]), "weights": [float(v) for v in w[1:]]}


def logistic_probability(model: dict, features: list[Column]) -> Column:
    z = sum((F.lit(w) * (f - m) / s for w, f, m, s in zip(model["weights"], features, model["mean"], model["scale"], strict=True)), F.lit(model["intercept"]))
    return 1 / (1 + F.exp(-z))
