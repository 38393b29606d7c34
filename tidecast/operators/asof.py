"""As-of and range joins without pair loops: both sides are sorted once by key and time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], max_days: int | None = None) -> DataFrame:
    """left with the values (and right_time) of the latest right row of its key at or before left_time, null where there is none
    or it is over max_days old. One exchange by key: the union of both sides, filled forward in time order. Of right rows of
    one time the greatest counts. With no keys the rows are dealt by the year of their time and filled over year ends."""
    packed = F.struct(F.col(right_time).alias("__rt"), *[F.col(v).alias(f"__{v}") for v in values])
    r = right.groupBy(*keys, F.col(right_time).alias("__t")).agg(F.max(packed).alias("__r")).withColumn("__side", F.lit(0))
    l = left.withColumn("__t", F.col(left_time)).withColumn("__side", F.lit(1))
    both = l.unionByName(r, allowMissingColumns=True)
    last = F.last("__r", ignorenulls=True)
    if keys:
        filled = both.withColumn("__f", last.over(Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)))
    else:
        year = F.year("__t")
        heads = r.groupBy((year + 1).alias("__y")).agg(F.max("__r").alias("__carry"))  # a row a year
        carry = heads.withColumn("__next", F.lead("__y").over(Window.orderBy("__y"))).select(F.explode(F.sequence("__y", F.coalesce(F.col("__next") - 1, F.col("__y") + 400))).alias("__y"), "__carry")
        own = both.withColumn("__y", year).withColumn("__o", last.over(Window.partitionBy("__y").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)))
        filled = own.join(F.broadcast(carry), "__y", "left").withColumn("__f", F.coalesce("__o", "__carry")).drop("__y", "__o", "__carry")
    fresh = F.lit(True) if max_days is None else F.datediff(F.col(left_time), F.col("__f.__rt")) <= max_days
    kept = [F.when(fresh, F.col(f"__f.__{v}")).alias(v) for v in values]
    return filled.filter("__side = 1").select(*left.columns, F.when(fresh, F.col("__f.__rt")).alias(right_time), *kept)


def running_total(df: DataFrame, keys: list[str], time: str, value: str, out: str) -> DataFrame:
    """df with the sum of value up to each row: a range sum is the difference of two as-of look-ups, not a range join."""
    return df.withColumn(out, F.sum(value).over(Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)))


def by_position(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(time)))


def newest_as_of(wanted: DataFrame, series: DataFrame, n: int, keys: list[str], as_of: str = "as_of", time: str = "date") -> DataFrame:
    """The newest n rows of a series at or before each wanted row's time: the columns of both, pos (1 for a series' first row) and age
    (1 for the newest). One as-of look-up of the last position, then an equi-join of the n positions behind it: as many rows as
    the result has, however long the series is. A time that a series holds twice counts as two rows."""
    placed = by_position(series, keys, time)
    last = as_of_join(wanted, placed.select(*keys, time, "pos"), keys, as_of, time, ["pos"]).drop(time).filter("pos is not null").withColumnRenamed("pos", "__last")
    rows = last.withColumn("pos", F.explode(F.sequence(F.greatest(F.col("__last") - n + 1, F.lit(1)), F.col("__last"))))
    return rows.join(placed, [*keys, "pos"]).withColumn("age", F.col("__last") - F.col("pos") + 1).drop("__last")
