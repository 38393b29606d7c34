"""What a forecast could be worth with more knowledge, policy-state features, the tone study and fresh prints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import inference as I
from .asof import as_of_join, running_total
from .forecast import overlay, shift_by_probability

#: How far policy features look back, in days, and where the age of a change is cut.
TRAILING_DAYS, YEARS_CUT = 180, 2.0


def shaped(draws: DataFrame, shape: str, size: float, side: Column, keys: list[str], share: float = 0.0, quiet: Column | None = None) -> DataFrame:
    """draws (keys, draw, value) under what an informed hand would do to them; side is 1 or -1, the way that it says the outcome lies.

    shift: moved by size sds. width: stretched about the mean by 1 + size where side is 1, by 1 - size elsewhere. tilt: deviations from the
    median stretched by size on the side named, shrunk by it on the other. mixture: a share of the draws, by hash, moved by size sds.
    calm: deviations from the median times size where quiet."""
    w = Window.partitionBy(*keys)
    mean, mid, sd = F.avg("value").over(w), F.median("value").over(w), F.stddev_pop("value").over(w)
    away = F.col("value") - mid
    to = {
        "shift": lambda: F.col("value") + size * sd * side,
        "width": lambda: mean + (1 + size * side) * (F.col("value") - mean),
        "tilt": lambda: mid + away * (1 + size * F.when(away * side > 0, 1.0).otherwise(-1.0)),
        "mixture": lambda: F.col("value") + F.when(I.uniform(F.lit("mixture"), F.col("draw")) < share, size * sd * side).otherwise(0.0),
        "calm": lambda: mid + F.when(quiet, size).otherwise(1.0) * away,
    }[shape]
    return draws.withColumn("value", to())


def scale_mixture(draws: DataFrame, keys: list[str], tau: float, centre: Column, ratio: Column, width: float = 1.0) -> DataFrame:
    """The same random numbers under another centre and spread: deviations from the mean times ratio (bounded by the caller), width and a
    log-normal scale of each draw with mean square 1, exp(tau z - tau ** 2); z is a normal number of the draw's hash."""
    u, v = (I.uniform(F.lit(name), F.col("draw")) for name in ("radius", "angle"))
    z = F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.pi() * v)
    deviation = F.col("value") - F.avg("value").over(Window.partitionBy(*keys))
    return draws.withColumn("value", centre + width * F.exp(tau * z - tau * tau) * ratio * deviation)


def policy_features(cards: DataFrame, changes: DataFrame, tones: DataFrame) -> DataFrame:
    """cards (unit_id, as_of) with s1, the sign of the last rate change, s2, the changes of the last TRAILING_DAYS in points, s3, years since the
    last change up to YEARS_CUT, x1, the tone of the last statement, and x2, its difference from the one before. changes: (date, bp);
    tones: (date, tone), one a date. Running totals and as-of look-ups, no pairs of cards and days."""
    total = running_total(changes.filter("bp != 0").withColumn("one", F.lit(0)), ["one"], "date", "bp", "total").select("date", "bp", "total")
    last = as_of_join(cards, total, [], "as_of", "date", ["bp", "total"]).withColumnRenamed("date", "changed").withColumn("before", F.date_sub("as_of", TRAILING_DAYS))
    early = as_of_join(last, total.select("date", F.col("total").alias("total0")), [], "before", "date", ["total0"]).drop("date")
    order = Window.orderBy("date")  # a row a date
    spoken = tones.select("date", F.col("tone").alias("x1"), F.lag("tone").over(order).alias("prior"))
    both = as_of_join(early, spoken, [], "as_of", "date", ["x1", "prior"])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return both.select(
        "unit_id", "as_of", zero(F.signum(F.col("bp")).cast("double")).alias("s1"), ((zero(F.col("total")) - zero(F.col("total0"))) / 100.0).alias("s2"),
        F.coalesce(F.least(F.datediff("as_of", "changed") / 365.0, F.lit(YEARS_CUT)), F.lit(YEARS_CUT)).alias("s3"), zero(F.col("x1")).alias("x1"), zero(F.col("x1") - F.col("prior")).alias("x2"),
    )


def study(rows: DataFrame, features: dict[str, list[str]], label: str, train: Column, key: str) -> tuple[DataFrame, dict[str, dict]]:
    """(arm, n, hits, auc) on the rows that are not for training, for each arm's features, with the models: logistic fits on the training rows.
    An arm without features says one half."""
    out, models = None, {}
    for arm, names in features.items():
        models[arm] = I.logistic(rows.filter(train), names, label) if names else None
        p = I.logistic_probability(models[arm], [F.col(c) for c in names]) if names else F.lit(0.5)
        held = rows.filter(~train).select(F.col(key).alias("key"), F.col(label).alias("label"), p.alias("p"))
        hits = held.agg(F.count("*").alias("n"), F.avg(((F.col("p") > 0.5) == (F.col("label") == 1)).cast("double")).alias("hits"))
        one = hits.crossJoin(I.auc(held, "p", "label", "key")).select(F.lit(arm).alias("arm"), "n", "hits", "auc")  # a row each
        out = one if out is None else out.unionByName(one)
    return out, models


def shifted_by_model(draws: DataFrame, features: DataFrame, model: dict, names: list[str], keys: list[str]) -> DataFrame:
    """draws (unit_id, ...) moved by the model's probability of a rise for their card, as the text overlay does."""
    p = features.select("unit_id", I.logistic_probability(model, [F.col(c) for c in names]).alias("__p"))
    return overlay(draws.join(p, "unit_id"), shift_by_probability(F.col("__p")), keys).drop("__p")


def fresh_prints(history: DataFrame, prints: DataFrame) -> DataFrame:
    """Prints (asset, ref, value), ref a month's first day, that follow a history's last month without a gap: the island of month less row number
    that starts at 1. history: (asset, date, value)."""
    last = history.groupBy("asset").agg(F.trunc(F.max("date"), "MM").alias("__last"))
    ahead = prints.join(last, "asset").withColumn("__k", F.months_between("ref", "__last").cast("int")).filter("__k > 0")
    place = F.row_number().over(Window.partitionBy("asset").orderBy("ref"))
    return ahead.withColumn("__island", F.col("__k") - place).filter("__island = 0").select("asset", "ref", "value", F.col("__k").alias("months"))


def append_prints(history: DataFrame, cells: DataFrame, prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """history with the fresh prints as new rows, and cells (asset, horizon, steps) with as many steps fewer, 1 at least."""
    fresh = fresh_prints(history, prints)
    gained = fresh.groupBy("asset").agg(F.count("*").alias("__gained"))
    rows = history.select("asset", "date", "value").unionByName(fresh.select("asset", F.col("ref").alias("date"), "value"))
    steps = F.greatest(F.col("steps") - F.coalesce("__gained", F.lit(0)), F.lit(1)).cast("int")
    return rows, cells.join(gained, "asset", "left").withColumn("steps", steps).drop("__gained")


def coordinate_descent(grid: DataFrame, axes: list[str], start: dict, score: str = "score", rounds: int = 2) -> list[dict]:
    """The way over a scored grid (a row a point, few thousand at most): along one axis at a time, to its best point with the others held,
    until a round changes nothing. All points are scored in one pass before; ties go to the lesser value."""
    points = {tuple(r[a] for a in axes): r[score] for r in grid.select(*axes, score).collect()}  # bounded by the grid's parameters
    at, way = tuple(start[a] for a in axes), []
    for _ in range(rounds):
        before = at
        for i, axis in enumerate(axes):
            line = [p for p in points if all(p[j] == at[j] for j in range(len(axes)) if j != i)]
            at = min(line, key=lambda p: (points[p], p[i]))
            way.append({"step": len(way) + 1, "axis": axis, **dict(zip(axes, at, strict=True)), score: points[at]})
        if at == before:
            break
    return way


def staleness(cards: DataFrame, panel: DataFrame, targets: DataFrame, days: int = 30) -> DataFrame:
    """(unit_id, asset, horizon, fresh, stale): how far the last value known at the as-of date, and the one known `days` earlier, lie from the
    realised value. cards: (unit_id, as_of, asset); targets: (unit_id, asset, horizon, value)."""
    k = cards.withColumn("__before", F.date_sub("as_of", days))
    fresh = as_of_join(k, panel, ["asset"], "as_of", "date", ["value"]).drop("date").withColumnRenamed("value", "__fresh")
    both = as_of_join(fresh, panel, ["asset"], "__before", "date", ["value"]).drop("date").withColumnRenamed("value", "__stale")
    return both.join(targets, ["unit_id", "asset"]).select("unit_id", "asset", "horizon", F.abs(F.col("value") - F.col("__fresh")).alias("fresh"), F.abs(F.col("value") - F.col("__stale")).alias("stale"))


