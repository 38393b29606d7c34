"""Checks that a set of draws is one exact grid, and the roster average that counts every failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The penalty and upper clip of a score, and the order of failure codes.
PENALTY = 4.0
GATES = ("g0_columns", "g1_grid", "g2_finite", "g3_occupancy")


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def finite_counts(draws: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, n_null, n_not_finite)."""
    v = F.col("value")
    return draws.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(v.isNull()).alias("n_null"), F.count_if(v.isNotNull() & ~is_finite(v)).alias("n_not_finite"))


def occupancy(draws: DataFrame, keys: list[str], n_draws: int, n_cells: int) -> DataFrame:
    """(keys, duplicated, missing): places of the grid filled more than once, and not at all. Counts by place, no full grid made."""
    filled = draws.filter(F.col("draw").between(0, n_draws - 1) & F.col("cell").between(0, n_cells - 1)).groupBy(*keys, "draw", "cell").agg(F.count("*").alias("n"))
    return filled.groupBy(*keys).agg(F.count_if(F.col("n") > 1).alias("duplicated"), (F.lit(n_draws * n_cells) - F.count("*")).alias("missing"))


def unknown_cells(draws: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, unknown): rows whose cell is not in the grid."""
    return draws.join(cells, "cell", "left_anti").groupBy(*keys).agg(F.count("*").alias("unknown"))


def axis_faults(assets: Column, horizons: Column) -> Column:
    """Null for proper axes: not empty, no value twice, horizons of 1 or more."""
    return (
        F.when((F.size(assets) == 0) | (F.size(horizons) == 0), "empty")
        .when((F.size(F.array_distinct(assets)) < F.size(assets)) | (F.size(F.array_distinct(horizons)) < F.size(horizons)), "repeated")
        .when(~F.forall(horizons, lambda h: h >= 1), "not_positive")
    )


def declared_grid(declared: Column, expected: Column) -> Column:
    """(equal, missing, extra, repeated) of a declared list against the expected one, order and multiplicity included."""
    return F.struct((declared == expected).alias("equal"), F.size(F.array_except(expected, declared)).alias("missing"), F.size(F.array_except(declared, expected)).alias("extra"), (F.size(declared) - F.size(F.array_distinct(declared))).alias("repeated"))


def first_failure(codes: list[tuple[str, Column]]) -> Column:
    """Name of the first gate that fails, null if all hold."""
    return F.coalesce(*[F.when(fails, F.lit(name)) for name, fails in codes])


def clipped(score: Column) -> Column:
    """A score within [0, PENALTY]; a missing one is the penalty."""
    return F.least(F.greatest(F.coalesce(score, F.lit(PENALTY)), F.lit(0.0)), F.lit(PENALTY))


def roster_mean(roster: DataFrame, scores: DataFrame, key: str = "unit_id") -> DataFrame:
    """(units, failed, unexpected, mean): every unit of the roster counts, scored or not; rows outside it only as a fault."""
    both = roster.select(key, F.lit(True).alias("expected")).join(scores.select(key, "score", F.lit(True).alias("found")), key, "full_outer")
    own = F.col("expected").isNotNull()
    return both.agg(
        F.count_if(own).alias("units"), F.count_if(own & F.col("score").isNull()).alias("failed"), F.count_if(~own).alias("unexpected"),
        F.avg(F.when(own, clipped(F.col("score")))).alias("mean"),
    )


def public_detail(code: Column, counts: Column) -> Column:
    """A failure's public form: its code and non-negative counts; free text cannot pass."""
    return F.struct(code.alias("code"), F.map_filter(counts.cast("map<string,bigint>"), lambda k, v: v >= 0).alias("counts"))
