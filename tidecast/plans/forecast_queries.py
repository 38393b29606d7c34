"""Queries on cards: as-of and range joins, outcomes, guards, moments, draws and overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import asof as A
from ..operators import forecast as M
from ..operators import inference as I
from ..operators import panels as P
from ..operators import scoring as S
from ..sources.adapters import HORIZONS, card_assets, cards, corpus, daily_panel, draws, outcome, return_panel, table, with_
from .base import Book, rounded
from .panel_queries import STEPS_SQL, _steps, business_day

book = Book()
CELLS_SQL = "cells AS (SELECT unit_id, as_of, asset, horizon FROM cards, (SELECT DISTINCT asset FROM panel), (VALUES (21), (63), (126)) h(horizon))"


def cells(spark, d) -> DataFrame:
    """(unit_id, as_of, asset, horizon) of all cards."""
    return card_assets(spark, d).withColumn("horizon", F.explode(F.array(*map(F.lit, HORIZONS))))


@book.add("j1_aligned_steps", f"{with_('panel')}{STEPS_SQL}, n AS (SELECT count(DISTINCT asset) AS n FROM steps) SELECT date, count(*) AS assets FROM steps, n GROUP BY date, n HAVING count(*) = n", dates="date")
def j1(spark, d):
    s = _steps(spark, d)
    n = s.select("asset").distinct().count()
    return M.aligned_steps(s, [], n).groupBy("date").agg(F.count("*").alias("assets"))


@book.add("j2_pairwise_correlation", f"{with_('panel')}{STEPS_SQL} SELECT a.asset AS asset_a, b.asset AS asset_b, count(*) AS n, round(CASE WHEN count(*) >= 30 THEN coalesce(corr(a.step, b.step), 0) ELSE 0 END, 6) AS corr FROM steps a JOIN steps b ON a.date = b.date AND a.asset < b.asset GROUP BY ALL")
def j2(spark, d):
    s = _steps(spark, d)
    a, b = s.select("date", F.col("asset").alias("asset_a"), F.col("step").alias("x")), s.select("date", F.col("asset").alias("asset_b"), F.col("step").alias("y"))
    return a.join(b, "date").filter("asset_a < asset_b").groupBy("asset_a", "asset_b").agg(F.count("*").alias("n"), rounded(F.when(F.count("*") >= 30, F.coalesce(F.corr("x", "y"), F.lit(0.0))).otherwise(0.0)).alias("corr"))


@book.add("j3_cell_pairs", f"{with_('draws')} SELECT a.cell AS a, b.cell AS b, round(covar_samp(a.value, b.value), 6) + 0.0 AS cov FROM draws a JOIN draws b ON a.draw = b.draw AND a.cell < b.cell GROUP BY ALL")
def j3(spark, d):
    v = draws(spark, d)
    a, b = v.select("draw", F.col("cell").alias("a"), F.col("value").alias("x")), v.select("draw", F.col("cell").alias("b"), F.col("value").alias("y"))
    return a.join(b, "draw").filter("a < b").groupBy("a", "b").agg((rounded(F.covar_samp("x", "y")) + 0.0).alias("cov"))  # no negative zero


@book.add("j4_as_of_documents", f"""{with_('cards', 'corpus')}, latest AS (SELECT doc_type, timestamp, max(doc_id) AS doc_id FROM corpus GROUP BY ALL), k AS (SELECT unit_id, as_of, doc_type FROM cards, (SELECT DISTINCT doc_type FROM latest))
SELECT unit_id, k.doc_type, timestamp, doc_id FROM k ASOF LEFT JOIN latest ON k.doc_type = latest.doc_type AND k.as_of >= latest.timestamp""", dates="timestamp")
def j4(spark, d):
    docs = corpus(spark, d).select("doc_type", "timestamp", "doc_id")
    left = cards(spark, d).withColumn("doc_type", F.explode(docs.agg(F.array_sort(F.collect_set("doc_type"))).scalar()))
    return A.as_of_join(left, docs, ["doc_type"], "as_of", "timestamp", ["doc_id"]).select("unit_id", "doc_type", "timestamp", "doc_id")


@book.add("j5_as_of_position", f"""{with_('panel', 'cards')}, {CELLS_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date) AS pos FROM panel),
k AS (SELECT cells.*, p.pos FROM cells ASOF JOIN p ON cells.asset = p.asset AND cells.as_of >= p.date)
SELECT k.unit_id, k.asset, k.horizon, p.date AS target, round(p.value, 2) AS value FROM k JOIN p ON p.asset = k.asset AND p.pos = k.pos + k.horizon""", dates="target")
def j5(spark, d):
    p = A.by_position(daily_panel(spark, d), ["asset"], "date")
    k = A.as_of_join(cells(spark, d), p.select("asset", "date", "pos"), ["asset"], "as_of", "date", ["pos"]).drop("date").filter("pos is not null")
    ahead = p.select("asset", F.col("pos").alias("target_pos"), F.col("date").alias("target"), "value")
    return k.withColumn("target_pos", F.col("pos") + F.col("horizon")).join(ahead, ["asset", "target_pos"]).select("unit_id", "asset", "horizon", "target", rounded("value", 2).alias("value"))


TARGETS_SQL = f"""{with_('panel', 'cards')}, {CELLS_SQL}, d AS (SELECT *, (as_of - greatest(isodow(as_of) - 5, 0)::INTEGER)::DATE AS start FROM cells),
t AS (SELECT *, (start - (isodow(start) - 1)::INTEGER + (((isodow(start) - 1 + horizon) // 5) * 7 + (isodow(start) - 1 + horizon) % 5)::INTEGER)::DATE AS target FROM d)"""


@book.add("j6_g20_realized_level", f"{TARGETS_SQL} SELECT unit_id, t.asset, horizon, target, CASE WHEN date_diff('day', date, target) <= 5 THEN round(value, 2) END AS value FROM t ASOF LEFT JOIN panel ON t.asset = panel.asset AND t.target >= panel.date", dates="target")
def j6(spark, d):
    left = cells(spark, d).withColumn("target", business_day(F.col("as_of"), F.col("horizon")))
    found = A.as_of_join(left, daily_panel(spark, d), ["asset"], "target", "date", ["value"], max_days=5)
    return found.select("unit_id", "asset", "horizon", "target", rounded("value", 2).alias("value"))


@book.add("j7_realized_return", f"""{with_('panel', 'returns', 'cards')}, {CELLS_SQL}, t AS (SELECT *, (as_of + horizon)::DATE AS target FROM cells)
SELECT t.unit_id, t.asset, t.horizon, count(r.value) AS n, round(coalesce(sum(ln(1 + r.value)), 0), 6) AS total FROM t LEFT JOIN returns r ON r.asset = t.asset AND r.date > t.as_of AND r.date <= t.target GROUP BY ALL""")
def j7(spark, d):
    """Two as-of look-ups in running totals: no pair of card and day is made."""
    r = return_panel(spark, d).withColumn("step", F.log1p("value"))
    r = A.by_position(A.running_total(r, ["asset"], "date", "step", "total"), ["asset"], "date").select("asset", "date", "total", "pos")
    left = cells(spark, d).withColumn("target", F.date_add("as_of", F.col("horizon")))
    early = A.as_of_join(left, r, ["asset"], "as_of", "date", ["total", "pos"]).drop("date").withColumnsRenamed({"total": "total0", "pos": "pos0"})
    late = A.as_of_join(early, r, ["asset"], "target", "date", ["total", "pos"])
    zero = lambda c: F.coalesce(c, F.lit(0))
    return late.select("unit_id", "asset", "horizon", (zero("pos") - zero("pos0")).cast("long").alias("n"), rounded(zero("total") - zero("total0")).alias("total"))


CHANGES_SQL = "c AS (SELECT o_orderdate::DATE AS d, sum(((o_orderkey % 5) - 2) * 25) AS bp FROM orders GROUP BY 1)"


def rate_moves(spark, d) -> DataFrame:
    """(d, bp): a change a day, by arithmetic on its orders."""
    return table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.sum((F.col("o_orderkey") % 5 - 2) * 25).alias("bp"))


@book.add("j8_policy_ranges", f"""WITH {CHANGES_SQL}
SELECT d, sum(bp) OVER (ORDER BY d RANGE BETWEEN INTERVAL 180 DAYS PRECEDING AND CURRENT ROW)::BIGINT AS trailing, coalesce(sum(bp) OVER (ORDER BY d RANGE BETWEEN INTERVAL 1 DAY FOLLOWING AND INTERVAL 90 DAYS FOLLOWING), 0)::BIGINT AS leading FROM c""", dates="d")
def j8(spark, d):
    days = F.datediff("d", F.lit("1970-01-01").cast("date"))
    w = Window.orderBy(days)  # a row a calendar day
    return rate_moves(spark, d).select("d", F.sum("bp").over(w.rangeBetween(-180, 0)).alias("trailing"), F.coalesce(F.sum("bp").over(w.rangeBetween(1, 90)), F.lit(0)).alias("leading"))


@book.add("j12_lookup", "SELECT r_name, count(*) AS n, round(sum(c_acctbal::DECIMAL(18,2))::DOUBLE, 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def j12(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return c.groupBy("r_name").agg(F.count("*").alias("n"), rounded(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double"), 2).alias("total"))


@book.add("j13_parameter_grid", f"{with_('cards')} SELECT unit_id, drift::DOUBLE AS drift, k::DOUBLE AS k, round(drift::DOUBLE * 10 + k::DOUBLE, 6) AS code FROM cards, (VALUES (0.5), (0.9)) a(drift), (VALUES (0.95), (1.0), (1.05)) b(k)")
def j13(spark, d):
    grid = spark.createDataFrame([(a, b) for a in (0.5, 0.9) for b in (0.95, 1.0, 1.05)], "drift double, k double")
    return cards(spark, d).crossJoin(F.broadcast(grid)).select("unit_id", "drift", "k", rounded(F.col("drift") * 10 + F.col("k")).alias("code"))


OWN_SQL = "own AS (SELECT unit_id, as_of, ['1-URGENT', CASE WHEN month(as_of) % 2 = 0 THEN '5-LOW' ELSE '2-HIGH' END] AS own FROM cards)"


def _own(spark, d) -> DataFrame:
    return cards(spark, d).withColumn("own", F.array(F.lit("1-URGENT"), F.when(F.month("as_of") % 2 == 0, "5-LOW").otherwise("2-HIGH")))


@book.add("j14_reference_events", f"{with_('cards')}, {OWN_SQL}, a AS (SELECT DISTINCT o_orderpriority AS asset FROM orders) SELECT unit_id, asset, h AS horizon FROM own, a, (VALUES (21), (63)) t(h) WHERE NOT list_contains(own, asset)")
def j14(spark, d):
    assets = table(spark, d, "orders").select(F.col("o_orderpriority").alias("asset")).distinct()
    return _own(spark, d).crossJoin(F.broadcast(assets)).filter(~F.array_contains("own", F.col("asset"))).select("unit_id", "asset", F.explode(F.array(F.lit(21), F.lit(63))).alias("horizon"))


@book.add("f15_overlap_guard", f"{with_('cards')}, {OWN_SQL}, practice AS (SELECT '5-LOW' AS asset, (as_of + 5)::DATE AS seen FROM cards WHERE month(as_of) < 6) SELECT unit_id FROM own WHERE NOT EXISTS (SELECT 1 FROM practice WHERE list_contains(own, asset) AND abs(date_diff('day', as_of, seen)) <= 7)")
def f15(spark, d):
    c = _own(spark, d)
    practice = cards(spark, d).filter(F.month("as_of") < 6).select(F.lit("5-LOW").alias("asset"), F.date_add("as_of", 5).alias("seen"))
    near = practice.withColumn("week", F.explode(F.sequence(F.floor(F.datediff("seen", F.lit("1970-01-01").cast("date")) / 8) - 1, F.floor(F.datediff("seen", F.lit("1970-01-01").cast("date")) / 8) + 1)))
    own = c.select("unit_id", "as_of", F.explode("own").alias("asset"), F.floor(F.datediff("as_of", F.lit("1970-01-01").cast("date")) / 8).alias("week"))
    hit = own.join(near, ["asset", "week"]).filter(F.abs(F.datediff("as_of", "seen")) <= 7).select("unit_id").distinct()  # an equi-join on asset and week, not a range over all pairs
    return c.select("unit_id").join(hit, "unit_id", "left_anti")


@book.add("f16_template", f"{with_('cards')}, {OWN_SQL} SELECT unit_id, list_aggregate(list_transform(own, lambda a: a LIKE '%-H%' OR a LIKE '1-%'), 'bool_and') AS matches FROM own")
def f16(spark, d):
    return _own(spark, d).select("unit_id", F.forall("own", lambda a: F.contains(a, F.lit("-H")) | F.startswith(a, F.lit("1-"))).alias("matches"))


@book.add("f13_corpus_coverage", f"""{with_('corpus')}, listed AS (SELECT doc_id, timestamp FROM corpus WHERE doc_id % 9 <> 0), held AS (SELECT doc_id FROM corpus WHERE doc_id % 10 <> 0)
SELECT (SELECT count(*) FROM listed WHERE timestamp > DATE '2000-01-01') AS late, (SELECT count(*) FROM listed ANTI JOIN held USING (doc_id)) AS missing, (SELECT count(*) FROM held ANTI JOIN listed USING (doc_id)) AS unlisted""")
def f13(spark, d):
    c = corpus(spark, d)
    listed, held = c.filter("doc_id % 9 <> 0").select("doc_id", "timestamp", F.lit(1).alias("l")), c.filter("doc_id % 10 <> 0").select("doc_id", F.lit(1).alias("h"))
    return listed.join(held, "doc_id", "full_outer").agg(F.count_if(F.col("timestamp") > "2000-01-01").alias("late"), F.count_if(F.col("h").isNull()).alias("missing"), F.count_if(F.col("l").isNull()).alias("unlisted"))


def _known(spark, d, n: int = 300) -> DataFrame:
    """(unit_id, as_of, asset, date, value, age): each card's newest n rows as of its date; the newest is the anchor."""
    return A.newest_as_of(card_assets(spark, d), daily_panel(spark, d), n, ["asset"])


def _card_steps(known: DataFrame) -> DataFrame:
    """(unit_id, asset, date, step) of known rows, holes dropped."""
    own = Window.partitionBy("unit_id", "asset")
    t = known.withColumn("step", F.col("value") - F.lag("value").over(own.orderBy("date"))).withColumn("gap", F.datediff("date", F.lag("date").over(own.orderBy("date"))))
    t = t.withColumn("threshold", P.hole_threshold(F.col("gap"), own)).filter("step is not null and gap <= threshold")
    return t.select("unit_id", "asset", "date", "step")


M0_SQL = f"""{with_('panel', 'cards')}, known AS (SELECT unit_id, asset, date, value FROM cards JOIN panel ON date <= as_of QUALIFY row_number() OVER (PARTITION BY unit_id, asset ORDER BY date DESC) <= 300),
g AS (SELECT *, value - lag(value) OVER w AS step, date_diff('day', lag(date) OVER w, date) AS gap FROM known WINDOW w AS (PARTITION BY unit_id, asset ORDER BY date)),
l AS (SELECT unit_id, asset, greatest(10 * median(gap), 5) AS threshold FROM g GROUP BY ALL), st AS (SELECT g.* FROM g JOIN l ON g.unit_id = l.unit_id AND g.asset = l.asset WHERE step IS NOT NULL AND gap <= threshold),
x AS (SELECT unit_id, date, list(struct_pack(asset := asset, step := step)) AS l FROM st GROUP BY ALL HAVING count(*) = 5), p AS (SELECT unit_id, l, unnest(l) AS a FROM x), q AS (SELECT unit_id, a, unnest(l) AS b FROM p),
anchor AS (SELECT unit_id, asset, arg_max(value, date) AS anchor FROM known GROUP BY ALL), mu AS (SELECT unit_id, a.asset AS asset, avg(a.step) AS mu FROM p GROUP BY ALL),
cv AS (SELECT unit_id, a.asset AS asset_a, b.asset AS asset_b, covar_samp(a.step, b.step) AS cov FROM q GROUP BY ALL)"""


def _cells_of(known: DataFrame) -> DataFrame:
    """(unit_id, asset, horizon, steps, anchor, cell) of the assets that a card has rows of."""
    c = known.filter("age = 1").select("unit_id", "asset", F.col("value").alias("anchor")).withColumn("horizon", F.explode(F.array(*map(F.lit, HORIZONS))))
    number = F.row_number().over(Window.partitionBy("unit_id").orderBy("asset", "horizon")) - 1
    return c.select("unit_id", "asset", "horizon", F.col("horizon").alias("steps"), "anchor", number.alias("cell"))


def _moments(known: DataFrame):
    return M.moments(M.aligned_steps(_card_steps(known), ["unit_id"], 5), ["unit_id"])


@book.add("g1_m0_moments", f"""{M0_SQL} SELECT cv.unit_id, cv.asset_a, cv.asset_b, ha AS horizon_a, hb AS horizon_b, round(anchor + ha * mu, 5) AS mean_a, round(least(ha, hb) * cov / 1e6, 5) AS cov
FROM cv JOIN mu ON mu.unit_id = cv.unit_id AND mu.asset = asset_a JOIN anchor n ON n.unit_id = cv.unit_id AND n.asset = asset_a, (VALUES (21), (63), (126)) a(ha), (VALUES (21), (63), (126)) b(hb)""")
def g1(spark, d):
    known = _known(spark, d)
    mu, cov = _moments(known)
    c = _cells_of(known)
    pairs = M.cell_moments(c, mu, cov, ["unit_id"])
    name = lambda n: c.select("unit_id", F.col("cell").alias(n), F.col("asset").alias(f"asset_{n}"), F.col("horizon").alias(f"horizon_{n}"))
    named = pairs.join(name("a"), ["unit_id", "a"]).join(name("b"), ["unit_id", "b"])
    return named.select("unit_id", "asset_a", "asset_b", "horizon_a", "horizon_b", rounded("mean_a", 5).alias("mean_a"), rounded(F.col("cov") / 1e6, 5).alias("cov"))


@book.add("g1_m0_draws")
def g1_draws(spark, d):
    """Random draws have no SQL form; tests check their seeds, moments and repeatability."""
    known = _known(spark, d)
    mu, cov = _moments(known)
    c = _cells_of(known)
    return M.sample(M.cell_moments(c, mu, cov, ["unit_id"]), c)


@book.add("c23_seeds", f"{with_('cards')} SELECT unit_id, md5(unit_id) AS digest, sha256(unit_id) AS commitment FROM cards")
def c23(spark, d):
    return cards(spark, d).select("unit_id", F.md5(F.col("unit_id").cast("binary")).alias("digest"), F.sha2(F.col("unit_id").cast("binary"), 256).alias("commitment"))


P_SQL = "least(greatest(0.25 * (2 * p - 1), -0.1), 0.1)"


@book.add("g14_text_overlay", f"{with_('draws')}, w AS (SELECT *, 1 / (1 + exp(-(asset - 1.5))) AS p, stddev_pop(value) OVER (PARTITION BY cell) AS sd FROM draws) SELECT draw, cell, round(value + {P_SQL} * sd, 6) AS value FROM w")
def g14(spark, d):
    p = 1 / (1 + F.exp(-(F.col("asset") - 1.5)))
    return M.overlay(draws(spark, d), M.shift_by_probability(p), ["cell"]).select("draw", "cell", rounded("value").alias("value"))


@book.add("g15_width_overlay", f"{with_('draws')}, w AS (SELECT *, median(value) OVER (PARTITION BY cell) AS m, stddev_pop(value) OVER (PARTITION BY cell) AS sd FROM draws) SELECT draw, cell, round(m + (value - m) * least(1 + 0.08 * horizon, 1.15) + 0.1 * sd, 6) AS value FROM w")
def g15(spark, d):
    return M.widen(draws(spark, d), F.least(1 + 0.08 * F.col("horizon"), F.lit(1.15)), ["cell"], 0.1).select("draw", "cell", rounded("value").alias("value"))


@book.add("g10_common_random_numbers", f"{with_('draws')}, w AS (SELECT *, avg(value) OVER (PARTITION BY cell) AS m FROM draws) SELECT draw, cell, round(0.1 + 0.5 * (m - 0.1) + 0.95 * (value - m), 6) AS value FROM w")
def g10(spark, d):
    return M.random_number_transform(draws(spark, d).withColumn("anchor", F.lit(0.1)), ["cell"], 0.5, 0.95).select("draw", "cell", rounded("value").alias("value"))


@book.add("g19_template_cards", f"""{with_('panel')}, p AS (SELECT DISTINCT date FROM panel), s AS (SELECT date FROM p ORDER BY md5(date || '|11'), date LIMIT 25) SELECT 'pseudo-' || date AS unit_id, (date - greatest(isodow(date) - 5, 0)::INTEGER)::DATE AS as_of FROM s""", dates="as_of")
def g19(spark, d):
    """A template set on 25 dates sampled by hash, rolled back to weekdays."""
    dates = daily_panel(spark, d).select("date").distinct().orderBy(F.md5(F.concat(F.col("date").cast("string"), F.lit("|11")).cast("binary")), "date").limit(25)
    return dates.select(F.concat(F.lit("pseudo-"), F.col("date").cast("string")).alias("unit_id"), business_day(F.col("date"), F.lit(0)).alias("as_of"))


@book.add("g23_staleness", f"""{with_('panel', 'cards')}, e AS (SELECT unit_id, asset, as_of, date, value FROM cards JOIN panel ON date <= as_of), f AS (SELECT unit_id, asset, arg_max(value, date) AS fresh, arg_max(value, date) FILTER (WHERE date <= as_of - 30) AS stale FROM e GROUP BY ALL)
SELECT unit_id, round(avg(abs(fresh - stale) / fresh), 6) AS moved FROM f GROUP BY unit_id""")
def g23(spark, d):
    p = daily_panel(spark, d)
    k = card_assets(spark, d).withColumn("before", F.date_sub("as_of", 30))
    fresh = A.as_of_join(k, p, ["asset"], "as_of", "date", ["value"]).drop("date").withColumnRenamed("value", "fresh")
    both = A.as_of_join(fresh, p, ["asset"], "before", "date", ["value"]).filter("fresh is not null")
    return both.groupBy("unit_id").agg(rounded(F.avg(F.abs(F.col("fresh") - F.col("value")) / F.col("fresh"))).alias("moved"))


@book.add("g24_grid_search", f"""{with_('draws', 'outcome')}, g AS (SELECT unnest([0.8, 0.9, 1.0, 1.1, 1.2])::DOUBLE AS k), w AS (SELECT k, cell, m + k * (value - m) AS value, y, row_number() OVER (PARTITION BY k, cell ORDER BY value, draw) AS r, count(*) OVER (PARTITION BY k, cell) AS n FROM (SELECT *, avg(value) OVER (PARTITION BY cell) AS m FROM draws) d, g JOIN outcome o ON true WHERE o.cell = d.cell),
c AS (SELECT k, cell, avg(abs(value - y)) - sum((2 * r - n - 1) * value) / (max(n) * max(n)) AS c FROM w GROUP BY k, cell) SELECT k, round(avg(c), 6) AS score FROM c GROUP BY k""".replace("FROM (SELECT *, avg(value) OVER (PARTITION BY cell) AS m FROM draws) d, g JOIN outcome o ON true WHERE o.cell = d.cell)", "FROM (SELECT draws.*, y, avg(value) OVER (PARTITION BY draws.cell) AS m FROM draws JOIN outcome ON outcome.cell = draws.cell) d, g)"))
def g24(spark, d):
    """Widths scored in one pass over cached draws: the grid is a column, not a driver loop."""
    grid = spark.createDataFrame([(k,) for k in (0.8, 0.9, 1.0, 1.1, 1.2)], "k double")
    v = draws(spark, d).withColumn("m", F.avg("value").over(Window.partitionBy("cell"))).crossJoin(F.broadcast(grid))
    scored = S.crps(v.withColumn("value", F.col("m") + F.col("k") * (F.col("value") - F.col("m"))), outcome(spark, d), ["k"])
    return scored.groupBy("k").agg(rounded(F.avg("crps")).alias("score"))


@book.add("g26_orientation", "SELECT n_name, CASE WHEN n_nationkey % 3 = 0 THEN -1 ELSE 1 END AS sign FROM nation")
def g26(spark, d):
    quotes = F.create_map(F.lit(0), F.lit(-1))
    return table(spark, d, "nation").select("n_name", F.coalesce(quotes[(F.col("n_nationkey") % 3).cast("int")], F.lit(1)).alias("sign"))


@book.add("w8_latest_and_previous", f"""{with_('cards', 'corpus')}, s AS (SELECT timestamp, max(doc_id) AS doc_id FROM corpus WHERE doc_type = 'src1' GROUP BY 1), p AS (SELECT *, lag(doc_id) OVER (ORDER BY timestamp) AS previous FROM s)
SELECT unit_id, doc_id, previous FROM cards ASOF LEFT JOIN p ON as_of >= timestamp""")
def w8(spark, d):
    s = corpus(spark, d).filter("doc_type = 'src1'").groupBy("timestamp").agg(F.max("doc_id").alias("doc_id"))
    s = s.withColumn("previous", F.lag("doc_id").over(Window.orderBy("timestamp")))  # a row a calendar day
    return A.as_of_join(cards(spark, d), s, [], "as_of", "timestamp", ["doc_id", "previous"]).select("unit_id", "doc_id", "previous")


def _walks(spark, d, forecaster) -> DataFrame:
    from ..operators import walks as W

    c = card_assets(spark, d).withColumn("horizons", F.array(*map(F.lit, HORIZONS)))
    return W.forecast(W.newest_rows(daily_panel(spark, d), c), forecaster)


@book.add("g8_reference_walk")
def g8(spark, d):
    from ..operators.walks import walk

    return _walks(spark, d, walk)


@book.add("g11_blended_walk")
def g11(spark, d):
    from ..operators.walks import blended_walk

    return _walks(spark, d, blended_walk)


@book.add("x1_windowed_events", "SELECT ts::DATE AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL", dates="day")
def x1(spark, d):
    """The streaming extension's windows, over the table as a batch."""
    from ..streaming.events import windowed

    e = windowed(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return e.select(F.to_date("start").alias("day"), "event_type", "n", rounded("total", 4).alias("total"))
