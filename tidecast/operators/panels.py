"""Step, volatility and calendar operators on long panels (asset, date, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 300


def by_date():
    return Window.partitionBy("asset").orderBy("date")


def newest():
    return Window.partitionBy("asset").orderBy(F.desc("date"))


def by_asset():
    return Window.partitionBy("asset")


def normalise(df: DataFrame) -> DataFrame:
    """Any panel as (asset, date, value): either name of the asset column, dates as text or date, numbers only, nulls dropped."""
    name = "asset" if "asset" in df.columns else "asset_id"
    rows = df.select(F.col(name).cast("string").alias("asset"), F.to_date(F.substring(F.col("date").cast("string"), 1, 10)).alias("date"), F.expr("try_cast(value AS double)").alias("value"))
    return rows.filter("asset is not null and date is not null and value is not null and not isnan(value)")


def first_panel_wins(panels: DataFrame) -> DataFrame:
    """Of the rows (panel_order, asset, ...) those of each asset's first panel; a window, so a panel is read once."""
    return panels.withColumn("first_order", F.min("panel_order").over(by_asset())).filter("panel_order = first_order").drop("first_order")


def with_gap(panel: DataFrame) -> DataFrame:
    """panel with step (first difference) and gap (days since the row before)."""
    return panel.withColumn("step", F.col("value") - F.lag("value").over(by_date())).withColumn("gap", F.datediff("date", F.lag("date").over(by_date())))


def hole_threshold(gap: Column, over) -> Column:
    return F.greatest(F.median(gap).over(over) * 10.0, F.lit(5.0))


def drop_holes(panel: DataFrame) -> DataFrame:
    """Steps that do not span a data hole."""
    w = with_gap(panel).withColumn("threshold", hole_threshold(F.col("gap"), by_asset()))
    return w.filter("step is not null and gap <= threshold").drop("threshold")


def log_step(r: Column) -> Column:
    """log1p of a simple return above -1, else null."""
    return F.when(r > -1, F.log1p(r))


def strict_log_step(r: Column) -> Column:
    """log1p of a simple return; an error at -1 or below."""
    return F.when(r > -1, F.log1p(r)).otherwise(F.raise_error(F.lit("simple return of -1 or less")).cast("double"))


def month_ordinal(d: Column) -> Column:
    return F.year(d) * 12 + F.month(d) - 1


def monthly_steps(panel: DataFrame) -> DataFrame:
    """First differences between consecutive months only."""
    m = panel.withColumn("step", F.col("value") - F.lag("value").over(by_date())).withColumn("months", month_ordinal(F.col("date")) - F.lag(month_ordinal(F.col("date"))).over(by_date()))
    return m.filter("months = 1").drop("months")


def trailing(df: DataFrame, n: int = WINDOW) -> DataFrame:
    """Newest n rows of each asset, with age: 1 for the newest."""
    return df.withColumn("age", F.row_number().over(newest())).filter(F.col("age") <= n)


def spacing_days(panel: DataFrame, window: int = WINDOW) -> DataFrame:
    """Mean days between an asset's newest window + 1 rows without holes; 1.4 with fewer than three gaps."""
    t = trailing(panel, window + 1).withColumn("gap", F.datediff("date", F.lag("date").over(by_date()))).filter("gap is not null")
    t = t.withColumn("threshold", hole_threshold(F.col("gap"), by_asset()))
    spacing = F.when(F.count("*") < 3, 1.4).otherwise(F.coalesce(F.avg(F.when(F.col("gap") <= F.col("threshold"), F.col("gap"))), F.lit(1.4)))
    return t.groupBy("asset").agg(spacing.alias("spacing"))


def panel_steps_for(horizon: Column, spacing: Column) -> Column:
    """Steps of a horizon in business days: the horizon, unless counting by calendar spacing differs twofold or more."""
    counted = F.greatest(F.bround(horizon * 7.0 / 5.0 / spacing).cast("int"), F.lit(1))
    ratio = F.greatest(counted, horizon) / F.greatest(F.least(counted, horizon), F.lit(1))
    return F.when(ratio >= 2, counted).otherwise(horizon).cast("int")


def short_vol_scale(steps: DataFrame, short: int = 21, beta: float = 0.5) -> DataFrame:
    """(asset, sd, rms, scaled): window sd, root mean square of the newest steps, and sd * clip(rms / sd, 0.5, 2) ** beta."""
    t = trailing(steps)
    s = t.groupBy("asset").agg(F.stddev_samp("step").alias("sd"), F.sqrt(F.avg(F.when(F.col("age") <= short, F.col("step") * F.col("step")))).alias("rms"))
    return s.withColumn("scaled", F.col("sd") * F.pow(F.least(F.greatest(F.col("rms") / F.col("sd"), F.lit(0.5)), F.lit(2.0)), F.lit(beta)))


def robust_sd(steps: DataFrame, c: float = 3.0) -> DataFrame:
    """(asset, sd, mad, winsor): plain, median-deviation and winsorised step sd; the plain one for fewer than 20 steps or no spread."""
    t = trailing(steps).withColumn("mid", F.median("step").over(by_asset()))
    t = t.withColumn("spread", 1.4826 * F.median(F.abs(F.col("step") - F.col("mid"))).over(by_asset()))
    cut = F.least(F.greatest(F.col("step"), F.col("mid") - c * F.col("spread")), F.col("mid") + c * F.col("spread"))
    s = t.groupBy("asset").agg(F.count("*").alias("n"), F.stddev_samp("step").alias("sd"), F.max("spread").alias("spread"), F.stddev_samp(cut).alias("cut_sd"))
    plain = (F.col("n") < 20) | (F.col("spread") <= 0)
    return s.select("asset", "sd", F.when(plain, F.col("sd")).otherwise(F.col("spread")).alias("mad"), F.when(plain, F.col("sd")).otherwise(F.col("cut_sd")).alias("winsor"))


def ewma_variance(steps: DataFrame, decay: float = 0.94) -> DataFrame:
    """(asset, ewma): exponentially weighted mean square of the steps about their mean; the newest weighs most."""
    t = trailing(steps).withColumn("dev", F.col("step") - F.avg("step").over(by_asset())).withColumn("w", F.pow(F.lit(decay), F.col("age") - 1))
    return t.groupBy("asset").agg((F.sum(F.col("w") * F.col("dev") * F.col("dev")) / F.sum("w")).alias("ewma"))


def cadence(panel: DataFrame) -> DataFrame:
    """(asset, daily): 30 rows or more, no date twice, a median gap in (0, 3] and a median of 8 rows a month or more."""
    rows = panel.withColumn("gap", F.datediff("date", F.lag("date").over(by_date())))
    whole = rows.groupBy("asset").agg(F.count("*").alias("n"), F.countDistinct("date").alias("dates"), F.median("gap").alias("gap"))
    by_month = panel.groupBy("asset", F.trunc("date", "MM").alias("month")).agg(F.count("*").alias("rows")).groupBy("asset").agg(F.median("rows").alias("rows"))
    ok = (F.col("n") >= 30) & (F.col("n") == F.col("dates")) & (F.col("gap") > 0) & (F.col("gap") <= 3) & (F.col("rows") >= 8)
    return whole.join(by_month, "asset").select("asset", "n", F.coalesce(ok, F.lit(False)).alias("daily"))


def context_log_vol(panel: DataFrame, min_rows: int = 200, min_series: int = 3) -> DataFrame:
    """(n_series, log_vol): median over positive daily series of the sd of their newest log steps; null with too few series."""
    positive = panel.withColumn("least", F.min("value").over(by_asset())).filter("least > 0")
    t = trailing(positive, WINDOW + 1).withColumn("step", F.log("value") - F.lag(F.log("value")).over(by_date())).withColumn("gap", F.datediff("date", F.lag("date").over(by_date())))
    vol = t.groupBy("asset").agg(F.count("*").alias("n"), F.median("gap").alias("gap"), F.stddev_samp("step").alias("vol")).filter((F.col("n") >= min_rows) & (F.col("gap") <= 3))
    return vol.agg(F.count("*").alias("n_series"), F.when(F.count("*") >= min_series, F.median("vol")).alias("log_vol"))


def keep_latest(df: DataFrame, keys: list[str], newest: list[Column]) -> DataFrame:
    """One row of each key, the first by newest."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))).filter("__rn = 1").drop("__rn")


def vintage_spread(df: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """(asset, mismatches): keys whose vintages differ by more than the tolerance."""
    by_key = df.groupBy(*keys).agg((F.max("value") - F.min("value")).alias("spread")).filter(F.col("spread") > tolerance)
    return by_key.groupBy("asset").agg(F.count("*").alias("mismatches"))
