"""Queries of the main engine: cards of five shapes, the moments of their cells, draws, and the same under other parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import asof as A
from ..operators import engine as E
from ..sources.adapters import cards, daily_panel, monthly_panel, return_panel, with_
from .base import Book, rounded

book = Book()
ASSETS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
#: Every fifth card has the same shape: (shape, kind, assets, horizons); a monthly card's horizons are months.
SHAPES = [
    ("multi", "level", ASSETS, (21, 63, 126)), ("single", "level", ASSETS[:1], (21,)), ("transfer", "level", ASSETS[1:2], (21, 63)),
    ("monthly", "monthly", [ASSETS[0], ASSETS[4]], (1, 3, 6)), ("returns", "returns", ASSETS[:2], (21,)),
]
ROWS, HOLE = 601, 150  # rows of history; a transfer card lacks its newest but one to HOLE-th


def inputs(spark, d, variants: dict[str, dict] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cards, cells, known) for operators.engine."""
    numbered = cards(spark, d).withColumn("m", F.pmod(F.row_number().over(Window.orderBy("as_of")), F.lit(len(SHAPES))))  # a row a card of one panel
    shape = lambda i: F.struct(F.lit(SHAPES[i][0]).alias("shape"), F.lit(SHAPES[i][1]).alias("kind"), F.array(*map(F.lit, SHAPES[i][2])).alias("assets"), F.array(*map(F.lit, SHAPES[i][3])).alias("horizons"))
    shaped = numbered.withColumn("s", F.get(F.array(*map(shape, range(len(SHAPES)))), F.col("m"))).select("unit_id", "as_of", "s.*")
    wanted = shaped.select("unit_id", "as_of", "shape", "kind", F.explode("assets").alias("asset"))
    panel = lambda kind, df: df.select(F.lit(kind).alias("kind"), "asset", "date", "value")
    series = panel("level", daily_panel(spark, d)).unionByName(panel("monthly", monthly_panel(spark, d))).unionByName(panel("returns", return_panel(spark, d)))
    rows = A.newest_as_of(wanted, series, ROWS, ["kind", "asset"])
    known = rows.filter((F.col("shape") != "transfer") | (F.col("age") == 1) | (F.col("age") > HOLE)).select("unit_id", "kind", "asset", "date", "value")
    others = shaped.filter("shape = 'transfer'").withColumn("asset", F.explode(F.array_except(F.array(*map(F.lit, ASSETS)), F.col("assets")))).select("unit_id", "as_of", "asset")
    context = context_log_vol(A.newest_as_of(others, daily_panel(spark, d), E.WINDOW + 1, ["asset"]))
    cells = shaped.select("unit_id", "kind", F.explode("assets").alias("asset"), "horizons").select("unit_id", "asset", F.explode("horizons").alias("horizon"), "kind")
    cells = cells.select("unit_id", "asset", "horizon", F.when(F.col("kind") == "monthly", F.col("horizon")).alias("months"))
    n_cells = F.size("assets") * F.size("horizons")
    c = shaped.select("unit_id", "as_of", "kind", F.when(F.col("shape") == "single", "T2-F4").otherwise("T2-F1").alias("family"), n_cells.alias("n_cells")).join(context, "unit_id", "left")
    return E.parameterised(c, variants), cells, known


def context_log_vol(known: DataFrame, min_rows: int = 200, min_series: int = 3) -> DataFrame:
    """(unit_id, context_log_vol): median over the daily positive series (unit_id, asset, date, value) of the sd of their log steps; null with too few."""
    line = Window.partitionBy("unit_id", "asset").orderBy("date")
    own = Window.partitionBy("unit_id", "asset")
    rows = known.withColumn("least", F.min("value").over(own)).filter("least > 0").withColumns({"step": F.log("value") - F.log(F.lag("value").over(line)), "gap": F.datediff("date", F.lag("date").over(line))})
    vol = rows.groupBy("unit_id", "asset").agg(F.count("*").alias("n"), F.median("gap").alias("gap"), F.stddev_samp("step").alias("vol")).filter((F.col("n") >= min_rows) & (F.col("gap") <= 3))
    return vol.groupBy("unit_id").agg(F.when(F.count("*") >= min_series, F.median("vol")).alias("context_log_vol"))


def _shape_rows() -> str:
    return ", ".join(f"({i}, '{shape}', '{kind}', '{a}', {len(assets) * len(horizons)})" for i, (shape, kind, assets, horizons) in enumerate(SHAPES) for a in assets)


def _horizon_rows() -> str:
    return ", ".join(f"('{shape}', {h})" for shape, _, _, horizons in SHAPES for h in horizons)


def _features_sql(values: str) -> str:
    """CTEs up to c: a row for each variant and cell. values: rows (variant, drift of single cards, of others, beta, k of single, of others, hurst)."""
    names = ", ".join(f"'{a}'" for a in ASSETS)
    return f"""{with_('panel', 'monthly', 'returns', 'cards')}, shapes(m, shape, kind, asset, n_cells) AS (VALUES {_shape_rows()}), hs(shape, horizon) AS (VALUES {_horizon_rows()}),
v(variant, d1, d2, b1, b2, k1, k2, hurst) AS (VALUES {values}),
num AS (SELECT unit_id, as_of, row_number() OVER (ORDER BY as_of) % {len(SHAPES)} AS m FROM cards),
w AS (SELECT unit_id, as_of, shape, kind, asset, n_cells FROM num JOIN shapes ON num.m = shapes.m),
series AS (SELECT 'level' AS kind, asset, date, value FROM panel UNION ALL SELECT 'monthly', asset, date, value FROM monthly UNION ALL SELECT 'returns', asset, date, value FROM returns),
k0 AS (SELECT w.unit_id, w.shape, w.kind, w.asset, w.n_cells, date, value, row_number() OVER (PARTITION BY w.unit_id, w.asset ORDER BY date DESC) AS age0 FROM w JOIN series s ON w.kind = s.kind AND w.asset = s.asset AND date <= as_of),
k AS (SELECT * FROM k0 WHERE age0 <= {ROWS} AND (shape <> 'transfer' OR age0 = 1 OR age0 > {HOLE})),
g AS (SELECT *, row_number() OVER (PARTITION BY unit_id, asset ORDER BY date DESC) AS age, date_diff('day', lag(date) OVER o, date) AS gap, date_diff('month', lag(date) OVER o, date) AS months, value - lag(value) OVER o AS move,
  CASE WHEN kind = 'level' THEN ln(value / lag(value) OVER o) END AS lr FROM k WINDOW o AS (PARTITION BY unit_id, asset ORDER BY date)),
lim AS (SELECT unit_id, asset, greatest(10 * median(gap), 5) AS lim, greatest(10 * median(gap) FILTER (WHERE age < {E.WINDOW}), 5) AS near, greatest(10 * median(gap) FILTER (WHERE age <= {E.WINDOW}), 5) AS spaced FROM g GROUP BY ALL),
st AS (SELECT g.*, lim.near, lim.spaced, CASE kind WHEN 'returns' THEN ln(1 + value) WHEN 'monthly' THEN CASE WHEN months = 1 THEN move END ELSE CASE WHEN gap <= lim THEN move END END AS step, CASE WHEN gap <= lim THEN lr END AS log_step
  FROM g JOIN lim ON g.unit_id = lim.unit_id AND g.asset = lim.asset),
sa AS (SELECT *, CASE WHEN step IS NOT NULL THEN count(step) OVER (PARTITION BY unit_id, asset ORDER BY date DESC) END AS sage FROM st),
f0 AS (SELECT unit_id, any_value(shape) AS shape, any_value(kind) AS kind, any_value(n_cells) AS n_cells, asset, count(step) AS n_steps, stddev_samp(step) FILTER (WHERE sage <= {E.WINDOW}) AS sd, sqrt(avg(step * step) FILTER (WHERE sage <= {E.SHORT})) AS rms,
  avg(step) FILTER (WHERE sage <= {E.WINDOW}) AS mu, arg_max(value, date) AS newest, stddev_samp(log_step) AS sd_log, count(log_step) AS n_log, coalesce(max((kind = 'level' AND age < {E.WINDOW} AND gap > near)::INTEGER), 0) = 1 AS hole,
  CASE WHEN count(gap) FILTER (WHERE age <= {E.WINDOW}) < 3 THEN 1.4 ELSE coalesce(avg(gap) FILTER (WHERE age <= {E.WINDOW} AND gap <= spaced), 1.4) END AS spacing FROM sa GROUP BY unit_id, asset),
cx AS (SELECT unit_id, CASE WHEN count(*) >= 3 THEN median(vol) END AS ctx FROM (SELECT unit_id, asset, stddev_samp(lr) AS vol FROM
  (SELECT unit_id, asset, date, value, ln(value / lag(value) OVER o) AS lr, date_diff('day', lag(date) OVER o, date) AS gap FROM
    (SELECT num.unit_id, p.asset, date, value FROM num JOIN panel p ON date <= as_of WHERE num.m = 2 AND p.asset IN ({names}) AND p.asset <> '{SHAPES[2][2][0]}' QUALIFY row_number() OVER (PARTITION BY num.unit_id, p.asset ORDER BY date DESC) <= {E.WINDOW + 1}) WINDOW o AS (PARTITION BY unit_id, asset ORDER BY date))
  GROUP BY unit_id, asset HAVING count(*) >= 200 AND median(gap) <= 3) GROUP BY unit_id),
f AS (SELECT variant, f0.*, hole AND n_log >= {E.LEAST_LOG_STEPS} AS moved, CASE WHEN n_cells > 1 AND kind <> 'monthly' THEN d2 ELSE d1 END AS drift, CASE WHEN kind = 'monthly' THEN 0.0 WHEN n_cells > 1 THEN b2 ELSE b1 END AS beta,
  CASE WHEN kind = 'monthly' THEN 1.0 WHEN n_cells > 1 THEN k2 ELSE k1 END * CASE WHEN shape = 'single' THEN 1.1 ELSE 1.0 END AS width, hurst, coalesce(ctx, sd_log) AS ctx FROM f0 CROSS JOIN v LEFT JOIN cx ON f0.unit_id = cx.unit_id),
e0 AS (SELECT *, CASE WHEN moved THEN newest * sqrt(sd_log * ctx) ELSE sd * pow(least(greatest(rms / sd, 0.5), 2.0), beta) END AS s, CASE WHEN moved THEN 0.0 ELSE mu END AS m, CASE WHEN kind = 'returns' THEN 0.0 ELSE newest END AS anchor FROM f),
ok AS (SELECT variant, unit_id FROM e0 GROUP BY ALL HAVING bool_and(n_steps >= {E.LEAST_STEPS} AND coalesce(s, 0) > 0)),
st2 AS (SELECT e0.*, hs.horizon, greatest(round_even(hs.horizon * 7.0 / 5.0 / spacing, 0)::INTEGER, 1) AS counted FROM e0 JOIN ok ON e0.variant = ok.variant AND e0.unit_id = ok.unit_id JOIN hs ON hs.shape = e0.shape),
c AS (SELECT variant, unit_id, kind, asset, horizon, CASE WHEN kind = 'monthly' THEN horizon WHEN greatest(counted, horizon) / greatest(least(counted, horizon), 1) >= 2 THEN counted ELSE horizon END AS steps, anchor, CASE WHEN kind = 'monthly' THEN 1.0 ELSE drift END * m AS m, s * width AS s, hurst FROM st2),
by_date AS (SELECT unit_id, date, list(struct_pack(asset := asset, step := step)) AS l FROM sa WHERE sage <= {E.WINDOW} GROUP BY ALL), p1 AS (SELECT unit_id, l, unnest(l) AS a FROM by_date), p2 AS (SELECT unit_id, a, unnest(l) AS b FROM p1),
r0 AS (SELECT unit_id, a.asset AS asset_a, b.asset AS asset_b, count(*) AS n, corr(a.step, b.step) AS c FROM p2 GROUP BY ALL), r AS (SELECT unit_id, asset_a, asset_b, CASE WHEN asset_a = asset_b THEN 1.0 WHEN n >= {E.LEAST_COMMON} THEN coalesce(c, 0) ELSE 0.0 END AS rho FROM r0)"""


BASE = "('base', 0.5, 0.9, 0.5, 0.0, 1.0, 1.05, 0.5)"


@book.add("g2_engine_moments", f"""{_features_sql(BASE)}
SELECT a.unit_id, a.asset AS asset_a, b.asset AS asset_b, a.horizon AS horizon_a, b.horizon AS horizon_b, a.steps AS steps_a, round(a.anchor + a.m * a.steps, 4) AS mean_a,
  round(least(a.steps, b.steps) * a.s * b.s * coalesce(rho, 0) / CASE WHEN a.kind = 'returns' THEN 1 ELSE 1e6 END, 5) AS cov
FROM c a JOIN c b ON a.unit_id = b.unit_id LEFT JOIN r ON r.unit_id = a.unit_id AND r.asset_a = a.asset AND r.asset_b = b.asset""")
def g2_moments(spark, d):
    """Means and covariances of all pairs of cells of each card: single, multi-cell, transfer, monthly and return cards."""
    c, cells, known = inputs(spark, d)
    named, pairs = E.moments(known, cells, c)
    side = lambda n: named.select("unit_id", F.col("cell").alias(n), F.col("horizon").alias(f"horizon_{n}"), F.col("steps").cast("long").alias(f"steps_{n}"), F.col("mean").alias(f"mean_{n}"))
    out = pairs.join(side("a"), ["unit_id", "a"]).join(side("b"), ["unit_id", "b"]).join(c.select("unit_id", "kind"), "unit_id")
    unit = F.when(F.col("kind") == "returns", 1.0).otherwise(1e6)
    return out.select("unit_id", "asset_a", "asset_b", "horizon_a", "horizon_b", "steps_a", rounded("mean_a", 4).alias("mean_a"), rounded(F.col("scale") * F.col("corr") / unit, 5).alias("cov"))


@book.add("g2_engine_draws")
def g2_draws(spark, d):
    """Random draws have no SQL form; tests check the ladder, seeds, moments and repeatability."""
    c, cells, known = inputs(spark, d)
    named, pairs = E.moments(known, cells, c)
    return E.draws(named, pairs, E.walk_cells(known, cells))


#: Parameters of the ablation, and the same for SQL: drift, beta and width of single and of other cards, and the horizon's exponent.
VARIANTS = {"base": {}, "plain drift": {"drift": 1.0}, "no vol of vol": {"beta": 0.0}, "wide": {"k": 1.2}, "rough": {"hurst": 0.45}}
_VARIANT_ROWS = ", ".join(
    f"('{n}', {v.get('drift', 0.5)}, {v.get('drift', 0.9)}, {v.get('beta', 0.5)}, {v.get('beta', 0.0)}, {v.get('k', 1.0)}, {v.get('k', 1.05)}, {v.get('hurst', 0.5)})" for n, v in VARIANTS.items()
)


@book.add("g27_ablation", f"""{_features_sql(_VARIANT_ROWS)}
SELECT variant, unit_id, asset, horizon, round(anchor + m * steps, 4) AS mean, round(s * pow(steps, hurst), 4) AS sd, row_number() OVER (PARTITION BY variant, unit_id ORDER BY asset, horizon) - 1 AS cell FROM c""")
def g27(spark, d):
    """Variants are rows of parameters beside the cards: one plan for all; cells are numbered in sorted order."""
    c, cells, known = inputs(spark, d, VARIANTS)
    named, pairs = E.moments(known, cells, c)
    own = pairs.filter("a = b").select("variant", "unit_id", F.col("a").alias("cell"), F.sqrt("scale").alias("spread"))
    out = named.join(own, ["variant", "unit_id", "cell"])
    return out.select("variant", "unit_id", "asset", "horizon", rounded("mean", 4).alias("mean"), rounded("spread", 4).alias("sd"), F.col("cell").cast("long").alias("cell"))
