"""Queries of the studies: informed shapes, scale mixtures, policy features, tone study, fresh prints, staleness, searches and further walks."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import asof as A
from ..operators import forecast as M
from ..operators import inference as I
from ..operators import scoring as S
from ..operators import study as T
from ..operators import walks as W
from ..sources.adapters import HORIZONS, card_assets, cards, corpus, daily_panel, draws, monthly_panel, outcome, table, with_
from .base import Book, rounded
from .forecast_queries import CHANGES_SQL, TARGETS_SQL, _cells_of, _known, _moments, cells, rate_moves
from .inference_queries import U
from .panel_queries import business_day
from .text_queries import DOWNS, UPS, _count_sql

book = Book()

SHAPES = {"shift": 0.25, "width": 0.2, "tilt": 0.3, "mixture": 1.5, "calm": 0.7}
SHARE = 0.2


@book.add("g16_oracle_shapes", f"""{with_('draws', 'outcome')}, w AS (SELECT draws.*, CASE WHEN {U("'coin|' || asset")} < 0.75 THEN 1 ELSE -1 END * sign(y - avg(value) OVER c) AS side, avg(value) OVER c AS m, median(value) OVER c AS md, stddev_pop(value) OVER c AS sd
  FROM draws JOIN outcome USING (cell) WINDOW c AS (PARTITION BY cell)), s AS (SELECT 'shift' AS shape, draw, cell, value + 0.25 * sd * side AS value FROM w UNION ALL SELECT 'width', draw, cell, m + (1 + 0.2 * side) * (value - m) FROM w
  UNION ALL SELECT 'tilt', draw, cell, md + (value - md) * (1 + 0.3 * CASE WHEN (value - md) * side > 0 THEN 1 ELSE -1 END) FROM w UNION ALL SELECT 'mixture', draw, cell, value + CASE WHEN {U("'mixture|' || draw")} < {SHARE} THEN 1.5 * sd * side ELSE 0 END FROM w
  UNION ALL SELECT 'calm', draw, cell, md + CASE WHEN cell % 2 = 0 THEN 0.7 ELSE 1 END * (value - md) FROM w)
SELECT shape, cell, count(*) AS n, round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value), 6) AS sd, round(min(value), 6) AS low, round(max(value), 6) AS high FROM s GROUP BY shape, cell""")
def g16(spark, d):
    """Five shapes, by a coin a card (here a series) that is right three times in four; the figures of each cell under each."""
    v = draws(spark, d).join(F.broadcast(outcome(spark, d)), "cell")  # an outcome a cell
    right = F.when(I.uniform(F.lit("coin"), F.col("asset")) < 0.75, 1).otherwise(-1)
    v = v.withColumn("side", right * F.signum(F.col("y") - F.avg("value").over(Window.partitionBy("cell"))))
    out = None
    for shape, size in SHAPES.items():
        one = T.shaped(v, shape, size, F.col("side"), ["cell"], SHARE, F.col("cell") % 2 == 0).withColumn("shape", F.lit(shape))
        out = one if out is None else out.unionByName(one)
    figures = {"mean": F.avg("value"), "sd": F.stddev_pop("value"), "low": F.min("value"), "high": F.max("value")}
    return out.groupBy("shape", "cell").agg(F.count("*").alias("n"), *[(rounded(c) + 0.0 if n == "mean" else rounded(c)).alias(n) for n, c in figures.items()])


@book.add("g10_scale_mixture", f"""{with_('draws')}, z AS (SELECT *, sqrt(-2 * ln(1 - {U("'radius|' || draw")})) * cos(2 * pi() * {U("'angle|' || draw")}) AS z, avg(value) OVER (PARTITION BY cell) AS m FROM draws)
SELECT draw, cell, round(0.1 + cell / 100.0 + 0.95 * exp(0.3 * z - 0.09) * 1.2 * (value - m), 6) AS value FROM z""")
def g10(spark, d):
    out = T.scale_mixture(draws(spark, d), ["cell"], 0.3, 0.1 + F.col("cell") / 100.0, F.lit(1.2), 0.95)
    return out.select("draw", "cell", rounded("value").alias("value"))


TONES_SQL = f"s AS (SELECT timestamp, avg(({_count_sql('lower(text)', UPS)} - {_count_sql('lower(text)', DOWNS)}) / ({_count_sql('lower(text)', UPS)} + {_count_sql('lower(text)', DOWNS)} + 1)) AS tone FROM corpus GROUP BY 1)"


def features(spark, d) -> DataFrame:
    tones = X.balances(corpus(spark, d), "text", tone=(UPS, DOWNS)).groupBy(F.col("timestamp").alias("date")).agg(F.avg("tone").alias("tone"))
    return T.policy_features(cards(spark, d), rate_moves(spark, d).withColumnRenamed("d", "date"), tones)


@book.add("g25_policy_features", f"""{with_('cards', 'corpus')}, {TONES_SQL}, {CHANGES_SQL}, t AS (SELECT d, bp, sum(bp) OVER (ORDER BY d) AS total FROM c WHERE bp <> 0), sp AS (SELECT timestamp, tone, lag(tone) OVER (ORDER BY timestamp) AS prior FROM s),
a AS (SELECT unit_id, as_of, t.d, t.bp, t.total FROM cards ASOF LEFT JOIN t ON as_of >= t.d), b AS (SELECT a.*, (as_of - {T.TRAILING_DAYS})::DATE AS early FROM a), e AS (SELECT b.*, t.total AS total0 FROM b ASOF LEFT JOIN t ON b.early >= t.d),
f AS (SELECT e.*, sp.tone, sp.prior FROM e ASOF LEFT JOIN sp ON e.as_of >= sp.timestamp)
SELECT unit_id, coalesce(sign(bp), 0)::DOUBLE AS s1, round((coalesce(total, 0) - coalesce(total0, 0)) / 100.0, 6) AS s2, round(coalesce(least(date_diff('day', d, as_of) / 365.0, {T.YEARS_CUT}), {T.YEARS_CUT}), 6) AS s3, round(coalesce(tone, 0), 6) AS x1, round(coalesce(tone - prior, 0), 6) + 0.0 AS x2 FROM f""")
def g25(spark, d):
    return features(spark, d).select("unit_id", "s1", *[(rounded(c) + 0.0).alias(c) for c in ("s2", "s3", "x1", "x2")])


ARMS = {"none": [], "state": ["s1", "s2", "s3"], "state and tone": ["s1", "s2", "s3", "x1", "x2"]}


def study_rows(spark, d) -> tuple[DataFrame, DataFrame]:
    """(cells of cards with features, y and label: whether the value ends above M0's mean; draws of M0 with y)."""
    known = _known(spark, d)
    mu, cov = _moments(known)
    c = _cells_of(known)
    p = A.by_position(daily_panel(spark, d), ["asset"], "date")
    at = A.as_of_join(cells(spark, d), p.select("asset", "date", "pos"), ["asset"], "as_of", "date", ["pos"]).filter("pos is not null")
    y = at.withColumn("pos", F.col("pos") + F.col("horizon")).join(p.select("asset", "pos", F.col("value").alias("y")), ["asset", "pos"]).select("unit_id", "as_of", "asset", "horizon", "y")
    mean = c.join(mu, ["unit_id", "asset"]).select("unit_id", "asset", "horizon", "cell", (F.col("anchor") + F.col("steps") * F.col("mu")).alias("mean"))
    rows = y.join(mean, ["unit_id", "asset", "horizon"]).join(features(spark, d).drop("as_of"), "unit_id")
    rows = rows.withColumn("label", (F.col("y") > F.col("mean")).cast("int")).withColumn("key", F.concat_ws("|", "unit_id", "asset", F.col("horizon").cast("string")))
    base = M.sample(M.cell_moments(c, mu, cov, ["unit_id"]), c, 200).join(rows.select("unit_id", "asset", "horizon", "cell", "y", "as_of"), ["unit_id", "asset", "horizon"])
    return rows, base


@book.add("g30_tone_study")
def g30(spark, d):
    """Arms with what each says on the later cards: hits, AUC, and the change of the mean CRPS when its probability moves the draws. Fits
    and draws have no SQL form; tests hold the fit and the parts against numpy."""
    rows, base = study_rows(spark, d)
    rows, base = rows.persist(), base.persist()  # a few numbers a cell, read by every arm
    train = F.col("as_of") < F.lit("1999-01-01").cast("date")
    out, models = T.study(rows, ARMS, "label", train, "key")
    held, keys = base.filter(~train).drop("as_of"), ["unit_id", "cell"]
    y = rows.filter(~train).select("unit_id", "cell", "y")
    score = lambda v: S.crps(v.select("unit_id", "draw", "cell", "value"), y, ["unit_id"]).agg(F.avg("crps").alias("crps")).first().crps  # noqa: E731  a number
    plain = score(held)
    change = [(arm, 0.0 if models[arm] is None or not plain else score(T.shifted_by_model(held, features(spark, d), models[arm], names, keys)) / plain - 1) for arm, names in ARMS.items()]
    return out.join(spark.createDataFrame(change, "arm string, crps_change double"), "arm").select("arm", "n", *[rounded(c).alias(c) for c in ("hits", "auc", "crps_change")])


PRINTS_SQL = """last AS (SELECT asset, max(date) AS m, arg_max(value, date) AS v FROM monthly GROUP BY asset), r AS (SELECT asset, m, k, (m + to_months(k::INTEGER))::DATE AS ref, v * (1 + k / 100.0) AS value FROM last, range(-1, 9) t(k) WHERE NOT (asset = '5-LOW' AND k = 3) AND NOT (asset = '2-HIGH' AND k = 1)),
i AS (SELECT *, k - row_number() OVER (PARTITION BY asset ORDER BY ref) AS island FROM r WHERE k > 0), fresh AS (SELECT asset, ref, value FROM i WHERE island = 0)"""


def prints(spark, d) -> DataFrame:
    """(asset, ref, value): prints from before the panel's last month on; one series lacks the third month, one the first."""
    last = monthly_panel(spark, d).groupBy("asset").agg(F.max("date").alias("m"), F.max_by("value", "date").alias("v"))
    k = last.withColumn("k", F.explode(F.sequence(F.lit(-1), F.lit(8)))).filter("not (asset = '5-LOW' and k = 3) and not (asset = '2-HIGH' and k = 1)")
    return k.select("asset", F.add_months("m", F.col("k")).alias("ref"), (F.col("v") * (1 + F.col("k") / 100.0)).alias("value"))


@book.add("f21_g13_fresh_prints", f"{with_('monthly')}, {PRINTS_SQL} SELECT asset, ref, round(value, 2) AS value FROM fresh", dates="ref")
def f21(spark, d):
    """Releases in an unbroken run of months from the panel's last; nothing follows a gap."""
    return T.fresh_prints(monthly_panel(spark, d), prints(spark, d)).select("asset", "ref", rounded("value", 2).alias("value"))


@book.add("g13_append_prints", f"""{with_('monthly')}, {PRINTS_SQL}, whole AS (SELECT asset, date, value FROM monthly UNION ALL SELECT asset, ref, value FROM fresh), g AS (SELECT asset, count(*) AS n FROM fresh GROUP BY asset)
SELECT w.asset, h AS horizon, count(*) AS n_rows, max(date) AS last_date, round(arg_max(value, date), 2) AS anchor, greatest(h - coalesce(any_value(n), 0), 1) AS steps FROM whole w LEFT JOIN g ON g.asset = w.asset, (VALUES (3), (12)) t(h) GROUP BY w.asset, h""", dates="last_date")
def g13(spark, d):
    """The anchor moves to the last print and the steps left are fewer."""
    m = monthly_panel(spark, d)
    cells_ = m.select("asset").distinct().withColumn("horizon", F.explode(F.array(F.lit(3), F.lit(12)))).withColumn("steps", F.col("horizon"))
    rows, left = T.append_prints(m, cells_, prints(spark, d))
    whole = rows.groupBy("asset").agg(F.count("*").alias("n_rows"), F.max("date").alias("last_date"), rounded(F.max_by("value", "date"), 2).alias("anchor"))
    return left.join(whole, "asset").select("asset", "horizon", "n_rows", "last_date", "anchor", F.col("steps").cast("long").alias("steps"))


@book.add("g18_pseudo_cards", f"""{with_('cards')}, a AS (SELECT DISTINCT o_orderpriority AS asset FROM orders), p AS (SELECT x.asset AS a, y.asset AS b FROM a x JOIN a y ON x.asset < y.asset),
s AS (SELECT 'single ' || asset AS shape, asset, h AS horizon FROM a, (VALUES (21), (63), (126)) t(h) UNION ALL SELECT 'pair ' || a || ' ' || b, unnest([a, b]), h FROM p, (VALUES (21), (63)) t(h) UNION ALL SELECT 'all', asset, h FROM a, (VALUES (21), (63), (126)) t(h))
SELECT unit_id, as_of, shape, count(*) AS cells, md5(string_agg(asset || ':' || horizon, ',' ORDER BY asset, horizon)) AS digest FROM cards, s GROUP BY ALL""", dates="as_of")
def g18(spark, d):
    """Every as-of date with every shape: each series alone, each pair, all together. Shapes are an array, so no join makes the grid."""
    names = table(spark, d, "orders").agg(F.array_sort(F.collect_set("o_orderpriority"))).scalar()
    cell = lambda assets, horizons: F.flatten(F.transform(assets, lambda a: F.transform(F.array(*map(F.lit, horizons)), lambda h: F.concat_ws(":", a, h.cast("string")))))
    shape = lambda name, assets, horizons: F.struct(name.alias("shape"), cell(assets, horizons).alias("cells"))
    c = cards(spark, d).withColumn("n", names)
    single = F.transform("n", lambda a: shape(F.concat(F.lit("single "), a), F.array(a), HORIZONS))
    pairs = F.flatten(F.transform("n", lambda a: F.transform(F.filter("n", lambda b: b > a), lambda b: shape(F.concat(F.lit("pair "), a, F.lit(" "), b), F.array(a, b), HORIZONS[:2]))))
    each = c.select("unit_id", "as_of", F.inline(F.concat(single, pairs, F.array(shape(F.lit("all"), F.col("n"), HORIZONS)))))
    return each.select("unit_id", "as_of", "shape", F.size("cells").cast("long").alias("cells"), F.md5(F.array_join("cells", ",").cast("binary")).alias("digest"))


@book.add("g23_staleness_value", f"""{TARGETS_SQL}, y AS (SELECT unit_id, t.asset, t.as_of, horizon, CASE WHEN date_diff('day', date, target) <= 5 THEN value END AS y FROM t ASOF LEFT JOIN panel ON t.asset = panel.asset AND t.target >= panel.date),
f AS (SELECT y.*, p.value AS fresh FROM y ASOF LEFT JOIN panel p ON y.asset = p.asset AND y.as_of >= p.date), b AS (SELECT f.*, (as_of - 30)::DATE AS early FROM f), g AS (SELECT b.*, p.value AS stale FROM b ASOF LEFT JOIN panel p ON b.asset = p.asset AND b.early >= p.date)
SELECT horizon, count(*) FILTER (WHERE y IS NOT NULL) AS n, round(avg(abs(y - fresh)) / avg(abs(y - stale)), 6) AS ratio FROM g GROUP BY horizon""")
def g23(spark, d):
    """What fresh anchors are worth: the mean miss of the last known value over that of the value known 30 days before."""
    target = cells(spark, d).withColumn("target", business_day(F.col("as_of"), F.col("horizon")))
    y = A.as_of_join(target, daily_panel(spark, d), ["asset"], "target", "date", ["value"], max_days=5).select("unit_id", "asset", "horizon", "value")
    miss = T.staleness(card_assets(spark, d), daily_panel(spark, d), y)
    return miss.groupBy("horizon").agg(F.count("fresh").alias("n"), rounded(F.avg("fresh") / F.avg("stale")).alias("ratio"))


WIDTHS, MOVES = (0.8, 0.9, 1.0, 1.1, 1.2), (-0.2, -0.1, 0.0, 0.1, 0.2)


def scored_grid(spark, d) -> DataFrame:
    """(k, s, score): the mean CRPS of draws stretched by k and moved by s sds, for all points in one pass; the grid is an array beside each draw."""
    points = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("s")) for k in WIDTHS for s in MOVES])
    w = Window.partitionBy("cell")
    v = draws(spark, d).withColumns({"m": F.avg("value").over(w), "sd": F.stddev_pop("value").over(w)}).select("*", F.inline(points))
    moved = v.withColumn("value", F.col("m") + F.col("k") * (F.col("value") - F.col("m")) + F.col("s") * F.col("sd"))
    return S.crps(moved, outcome(spark, d), ["k", "s"]).groupBy("k", "s").agg(rounded(F.avg("crps"), 9).alias("score"))


@book.add("g24_coordinate_descent", f"""{with_('draws', 'outcome')}, g AS (SELECT k::DOUBLE AS k, s::DOUBLE AS s FROM (SELECT unnest({list(WIDTHS)}) AS k), (SELECT unnest({list(MOVES)}) AS s)), b AS (SELECT draws.*, y, avg(value) OVER c AS m, stddev_pop(value) OVER c AS sd FROM draws JOIN outcome USING (cell) WINDOW c AS (PARTITION BY cell)),
v AS (SELECT k, s, cell, y, m + k * (value - m) + s * sd AS value, row_number() OVER (PARTITION BY k, s, cell ORDER BY value, draw) AS r, count(*) OVER (PARTITION BY k, s, cell) AS n FROM b, g), x AS (SELECT k, s, cell, avg(abs(value - y)) - sum((2 * r - n - 1) * value) / (max(n) * max(n)) AS c FROM v GROUP BY k, s, cell),
p AS (SELECT k, s, round(avg(c), 9) AS score FROM x GROUP BY k, s), one AS (SELECT 1 AS step, 'k' AS axis, k, s, score FROM p WHERE s = 0 ORDER BY score, k LIMIT 1), two AS (SELECT 2 AS step, 's' AS axis, k, s, score FROM p WHERE k = (SELECT k FROM one) ORDER BY score, s LIMIT 1)
SELECT * FROM one UNION ALL SELECT * FROM two""")
def g24(spark, d):
    way = T.coordinate_descent(scored_grid(spark, d), ["k", "s"], {"k": 1.0, "s": 0.0}, rounds=1)
    return spark.createDataFrame([(w["step"], w["axis"], w["k"], w["s"], w["score"]) for w in way], "step int, axis string, k double, s double, score double")


def _walk(spark, d, panel: DataFrame, forecaster, horizons, n: int = 300) -> DataFrame:
    c = card_assets(spark, d).withColumn("horizons", F.array(*map(F.lit, horizons)))
    return W.forecast(W.newest_rows(panel, c, n), forecaster)


def monthly(history, steps, n, key):
    """All series of a card read off the same months."""
    import numpy as np

    return W.monthly_walk(history, np.tile(np.array(steps), (history.shape[1], 1)), n, key)


@book.add("g9_monthly_walk")
def g9(spark, d):
    return _walk(spark, d, monthly_panel(spark, d), monthly, (1, 3, 6), 120)


@book.add("g12_garch_walk")
def g12(spark, d):
    return _walk(spark, d, daily_panel(spark, d), W.garch_walk, (21, 63))


@book.add("g10_segment_walk")
def g10_segments(spark, d):
    return _walk(spark, d, daily_panel(spark, d), partial(W.segment_walk, tau=0.2), HORIZONS)
