"""Queries on panels: scans, steps, holes, volatilities, windows and calendar arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import asof as A
from ..operators import panels as P
from ..sources.adapters import card_assets, cards, context_panel, daily_panel, monthly_panel, return_panel, table, with_
from .base import Book, rounded

book = Book()
STEPS_SQL = """, gaps AS (SELECT *, value - lag(value) OVER w AS step, date_diff('day', lag(date) OVER w, date) AS gap FROM panel WINDOW w AS (PARTITION BY asset ORDER BY date)),
limits AS (SELECT asset, greatest(10 * median(gap), 5) AS threshold FROM gaps GROUP BY asset),
steps AS (SELECT gaps.* FROM gaps JOIN limits USING (asset) WHERE step IS NOT NULL AND gap <= threshold),
win AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date DESC) AS age FROM steps QUALIFY age <= 300)"""


def _steps(spark, d) -> DataFrame:
    return P.drop_holes(daily_panel(spark, d))


@book.add("s1_panel_scan", """
SELECT 'lineitem' AS panel, count(*) AS n_rows, min(l_shipdate)::DATE AS first_date, max(l_shipdate)::DATE AS last_date FROM lineitem
UNION ALL SELECT 'orders', count(*), min(o_orderdate)::DATE, max(o_orderdate)::DATE FROM orders""", dates="first_date last_date")
def s1(spark, d):
    scan = lambda name, c: table(spark, d, name).select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.parquet", 1).alias("panel"), F.to_date(c).alias("date"))
    rows = scan("orders", "o_orderdate").unionByName(scan("lineitem", "l_shipdate"))
    return rows.groupBy("panel").agg(F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@book.add("s2_panel_normalise", """
SELECT o_orderstatus AS asset, o_orderdate::DATE AS date, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS value
FROM orders WHERE o_orderkey % 9 <> 0""", dates="date")
def s2(spark, d):
    raw = table(spark, d, "orders").select(F.col("o_orderstatus").alias("asset_id"), F.col("o_orderdate").cast("string").alias("date"), F.when(F.col("o_orderkey") % 9 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("value"))
    return P.normalise(raw)


@book.add("s3_longest_vintage", f"""{with_('panel')},
copies AS (SELECT 'early' AS vintage, * FROM panel WHERE date < DATE '1997-01-01' UNION ALL SELECT 'late', * FROM panel),
best AS (SELECT vintage FROM copies GROUP BY vintage ORDER BY max(date) DESC, vintage DESC LIMIT 1)
SELECT date, round(sum(value) FILTER (WHERE asset = '1-URGENT'), 2) AS urgent, round(sum(value) FILTER (WHERE asset = '5-LOW'), 2) AS low
FROM copies WHERE vintage IN (SELECT vintage FROM best) GROUP BY date""", dates="date")
def s3(spark, d):
    p = daily_panel(spark, d)
    copies = p.filter("date < '1997-01-01'").withColumn("vintage", F.lit("early")).unionByName(p.withColumn("vintage", F.lit("late")))
    best = copies.groupBy("vintage").agg(F.max("date").alias("end")).agg(F.max_by("vintage", F.struct("end", "vintage")).alias("vintage"))
    wide = copies.join(F.broadcast(best), "vintage").groupBy("date").pivot("asset", ["1-URGENT", "5-LOW"]).agg(F.sum("value"))
    return wide.select("date", rounded("1-URGENT", 2).alias("urgent"), rounded("5-LOW", 2).alias("low"))


@book.add("f1_as_of_filter", f"{with_('panel', 'cards')} SELECT unit_id, asset, count(*) AS n, max(date) AS last_date FROM cards JOIN panel ON date <= as_of GROUP BY ALL", dates="last_date")
def f1(spark, d):
    """How many rows a card may see is the position of the last of them."""
    p = A.by_position(daily_panel(spark, d), ["asset"], "date").select("asset", "date", "pos")
    k = A.as_of_join(card_assets(spark, d), p, ["asset"], "as_of", "date", ["pos"]).filter("pos is not null")
    return k.select("unit_id", "asset", F.col("pos").cast("long").alias("n"), F.col("date").alias("last_date"))


@book.add("f2_first_panel_wins", f"""{with_('panel', 'context')},
stacked AS (SELECT 0 AS k, asset, date FROM panel WHERE asset < '3' UNION ALL SELECT 1, asset, date FROM panel UNION ALL SELECT 2, asset, date FROM context)
SELECT k AS panel_order, asset, count(*) AS n FROM stacked WHERE (asset, k) IN (SELECT (asset, min(k)) FROM stacked GROUP BY asset) GROUP BY ALL""")
def f2(spark, d):
    p = daily_panel(spark, d)
    part = lambda df, k: df.select(F.lit(k).alias("panel_order"), "asset", "date")
    both = part(p.filter("asset < '3'"), 0).unionByName(part(p, 1)).unionByName(part(context_panel(spark, d), 2))
    return P.first_panel_wins(both).groupBy("panel_order", "asset").agg(F.count("*").alias("n"))


@book.add("f3_level_step", f"{with_('panel')} SELECT asset, date, round(value - lag(value) OVER (PARTITION BY asset ORDER BY date), 2) AS step FROM panel", dates="date")
def f3(spark, d):
    return P.with_gap(daily_panel(spark, d)).select("asset", "date", rounded("step", 2).alias("step"))


@book.add("f4_log_step", f"{with_('returns')} SELECT asset, date, CASE WHEN value > -0.5 THEN round(ln(1 + value), 6) END AS lenient, round(ln(1 + value), 6) AS strict FROM returns", dates="date")
def f4(spark, d):
    r = return_panel(spark, d)
    return r.select("asset", "date", rounded(P.log_step(F.when(F.col("value") > -0.5, F.col("value")).otherwise(-1.0))).alias("lenient"), rounded(P.strict_log_step(F.col("value"))).alias("strict"))


@book.add("f5_hole_filter", f"{with_('panel')}{STEPS_SQL} SELECT asset, date, round(step, 2) AS step, gap FROM steps", dates="date")
def f5(spark, d):
    return _steps(spark, d).select("asset", "date", rounded("step", 2).alias("step"), F.col("gap").cast("long").alias("gap"))


@book.add("f6_monthly_step", f"""{with_('monthly')}
SELECT asset, date, round(value - before, 2) AS step FROM (SELECT *, lag(value) OVER w AS before, lag(date) OVER w AS prior FROM monthly WINDOW w AS (PARTITION BY asset ORDER BY date))
WHERE date_diff('month', prior, date) = 1""", dates="date")
def f6(spark, d):
    return P.monthly_steps(monthly_panel(spark, d)).select("asset", "date", rounded("step", 2).alias("step"))


@book.add("f12_look_ahead", f"{with_('panel', 'cards')} SELECT unit_id, count(*) FILTER (WHERE date > as_of) AS after, count(*) FILTER (WHERE date + 1 > as_of) AS strict FROM panel, cards GROUP BY unit_id")
def f12(spark, d):
    """What is not yet known is the total less a running count by day, looked up as of each card, and as of the day before it."""
    days = daily_panel(spark, d).groupBy("date").agg(F.count("*").alias("here"))
    known = days.select("date", F.sum("here").over(Window.orderBy("date")).alias("n"))  # a row a calendar day
    total = days.agg(F.sum("here")).scalar()
    c = cards(spark, d).withColumn("before", F.date_sub("as_of", 1))
    at = A.as_of_join(c, known, [], "as_of", "date", ["n"]).drop("date").withColumnRenamed("n", "known")
    both = A.as_of_join(at, known, [], "before", "date", ["n"])
    left = lambda n: total - F.coalesce(F.col(n), F.lit(0))
    return both.select("unit_id", left("known").alias("after"), left("n").alias("strict"))


@book.add("a1_mean_step", f"{with_('panel')}{STEPS_SQL} SELECT asset, round(avg(step), 4) AS mu FROM win GROUP BY asset")
def a1(spark, d):
    return P.trailing(_steps(spark, d)).groupBy("asset").agg(rounded(F.avg("step"), 4).alias("mu"))


@book.add("a2_step_sd", f"{with_('panel')}{STEPS_SQL} SELECT asset, round(stddev_samp(step), 4) AS sd FROM win GROUP BY asset")
def a2(spark, d):
    return P.trailing(_steps(spark, d)).groupBy("asset").agg(rounded(F.stddev_samp("step"), 4).alias("sd"))


PAIRS_SQL = """, pairs AS (SELECT a.asset AS asset_a, b.asset AS asset_b, a.step AS x, b.step AS y FROM win a JOIN win b ON a.date = b.date)"""


def _pairs(spark, d) -> DataFrame:
    t = P.trailing(_steps(spark, d)).select("asset", "date", "step")
    return t.select(F.col("asset").alias("asset_a"), "date", F.col("step").alias("x")).join(t.select(F.col("asset").alias("asset_b"), "date", F.col("step").alias("y")), "date")


@book.add("a3_covariance", f"{with_('panel')}{STEPS_SQL}{PAIRS_SQL} SELECT asset_a, asset_b, round(covar_samp(x, y), 0) AS cov FROM pairs GROUP BY ALL")
def a3(spark, d):
    return _pairs(spark, d).groupBy("asset_a", "asset_b").agg(rounded(F.covar_samp("x", "y"), 0).alias("cov"))


@book.add("a4_correlation", f"{with_('panel')}{STEPS_SQL}{PAIRS_SQL} SELECT asset_a, asset_b, CASE WHEN asset_a = asset_b THEN 1.0 WHEN count(*) >= 30 THEN round(coalesce(corr(x, y), 0), 6) ELSE 0.0 END AS corr FROM pairs GROUP BY asset_a, asset_b")
def a4(spark, d):
    c = F.when(F.col("asset_a") == F.col("asset_b"), 1.0).when(F.count("*") >= 30, rounded(F.coalesce(F.corr("x", "y"), F.lit(0.0)))).otherwise(0.0)
    return _pairs(spark, d).groupBy("asset_a", "asset_b").agg(c.alias("corr"))


@book.add("a5_short_vol", f"""{with_('panel')}{STEPS_SQL},
s AS (SELECT asset, stddev_samp(step) AS sd, sqrt(avg(step * step) FILTER (WHERE age <= 21)) AS rms FROM win GROUP BY asset)
SELECT asset, round(sd, 4) AS sd, round(rms, 4) AS rms, round(sd * pow(least(greatest(rms / sd, 0.5), 2.0), 0.5), 4) AS scaled FROM s""")
def a5(spark, d):
    s = P.short_vol_scale(_steps(spark, d))
    return s.select("asset", *[rounded(c, 4).alias(c) for c in ("sd", "rms", "scaled")])


@book.add("a6_robust_sd", f"""{with_('panel')}{STEPS_SQL},
mid AS (SELECT asset, median(step) AS m FROM win GROUP BY asset),
mad AS (SELECT win.asset, any_value(m) AS m, 1.4826 * median(abs(step - m)) AS s FROM win JOIN mid ON win.asset = mid.asset GROUP BY win.asset)
SELECT win.asset, round(stddev_samp(step), 4) AS sd, round(CASE WHEN count(*) < 20 OR any_value(s) <= 0 THEN stddev_samp(step) ELSE any_value(s) END, 4) AS mad,
       round(CASE WHEN count(*) < 20 OR any_value(s) <= 0 THEN stddev_samp(step) ELSE stddev_samp(least(greatest(step, m - 3 * s), m + 3 * s)) END, 4) AS winsor
FROM win JOIN mad ON win.asset = mad.asset GROUP BY win.asset""")
def a6(spark, d):
    return P.robust_sd(_steps(spark, d)).select("asset", *[rounded(c, 4).alias(c) for c in ("sd", "mad", "winsor")])


EWMA_SQL = """, dev AS (SELECT asset, age, step - avg(step) OVER (PARTITION BY asset) AS x FROM win),
ew AS (SELECT asset, sum(pow(0.94, age - 1) * x * x) / sum(pow(0.94, age - 1)) AS ewma FROM dev GROUP BY asset)"""


@book.add("a7_ewma_variance", f"{with_('panel')}{STEPS_SQL}{EWMA_SQL} SELECT asset, round(ewma, 0) AS ewma FROM ew")
def a7(spark, d):
    return P.ewma_variance(_steps(spark, d)).select("asset", rounded("ewma", 0).alias("ewma"))


@book.add("a8_blended_variance", f"""{with_('panel')}{STEPS_SQL}
SELECT s.asset, round(sqrt(0.7 * var_w + 0.3 * var_l), 4) AS sd FROM (SELECT asset, var_samp(step) AS var_w FROM win GROUP BY asset) s
JOIN (SELECT asset, var_samp(step) AS var_l FROM steps GROUP BY asset) l ON s.asset = l.asset""")
def a8(spark, d):
    s = _steps(spark, d).withColumn("age", F.row_number().over(P.newest()))
    blend = 0.7 * F.var_samp(F.when(F.col("age") <= P.WINDOW, F.col("step"))) + 0.3 * F.var_samp("step")
    return s.groupBy("asset").agg(rounded(F.sqrt(blend), 4).alias("sd"))


SPACING_SQL = """, newest AS (SELECT * FROM panel QUALIFY row_number() OVER (PARTITION BY asset ORDER BY date DESC) <= 301),
sgaps AS (SELECT asset, date_diff('day', lag(date) OVER (PARTITION BY asset ORDER BY date), date) AS gap FROM newest),
slimit AS (SELECT asset, greatest(10 * median(gap), 5) AS threshold, count(gap) AS n FROM sgaps GROUP BY asset),
spacing AS (SELECT sgaps.asset, CASE WHEN any_value(n) < 3 THEN 1.4 ELSE coalesce(avg(gap) FILTER (WHERE gap <= threshold), 1.4) END AS spacing FROM sgaps JOIN slimit ON sgaps.asset = slimit.asset GROUP BY sgaps.asset)"""


@book.add("a9_spacing", f"{with_('panel')}{SPACING_SQL} SELECT asset, round(spacing, 6) AS spacing FROM spacing")
def a9(spark, d):
    return P.spacing_days(daily_panel(spark, d)).select("asset", rounded("spacing").alias("spacing"))


@book.add("a10_context_log_vol", f"""{with_('panel')}, newest AS (SELECT * FROM panel QUALIFY row_number() OVER (PARTITION BY asset ORDER BY date DESC) <= 301),
s AS (SELECT asset, ln(value) - lag(ln(value)) OVER w AS step, date_diff('day', lag(date) OVER w, date) AS gap FROM newest WINDOW w AS (PARTITION BY asset ORDER BY date)),
v AS (SELECT asset, count(*) AS n, median(gap) AS gap, stddev_samp(step) AS vol FROM s GROUP BY asset)
SELECT count(*) AS n_series, CASE WHEN count(*) >= 3 THEN round(median(vol), 6) END AS log_vol FROM v WHERE n >= 200 AND gap <= 3""")
def a10(spark, d):
    return P.context_log_vol(daily_panel(spark, d)).select("n_series", rounded("log_vol").alias("log_vol"))


VINTAGES_SQL = """, vintages AS (SELECT 'p' AS panel, asset, date, DATE '2001-01-01' AS unit_as_of, value FROM panel UNION ALL
SELECT 'p', asset, date, DATE '2001-06-01', value + 1 FROM panel WHERE day(date) % 7 = 0)"""


def _vintages(spark, d) -> DataFrame:
    p = daily_panel(spark, d).withColumn("panel", F.lit("p"))
    first = p.withColumn("unit_as_of", F.lit("2001-01-01").cast("date"))
    late = p.filter(F.day("date") % 7 == 0).withColumn("unit_as_of", F.lit("2001-06-01").cast("date")).withColumn("value", F.col("value") + 1)
    return first.unionByName(late)


@book.add("a30_vintage_mismatch", f"{with_('panel')}{VINTAGES_SQL}, s AS (SELECT panel, asset, date, max(value) - min(value) AS spread FROM vintages GROUP BY ALL) SELECT asset, count(*) AS mismatches FROM s WHERE spread > 1e-9 GROUP BY asset")
def a30(spark, d):
    return P.vintage_spread(_vintages(spark, d), ["panel", "asset", "date"])


@book.add("w9_g21_latest_vintage", f"{with_('panel')}{VINTAGES_SQL} SELECT asset, date, unit_as_of, round(value, 2) AS value FROM vintages QUALIFY row_number() OVER (PARTITION BY panel, asset, date ORDER BY unit_as_of DESC, value DESC) = 1", dates="date unit_as_of")
def w9(spark, d):
    latest = P.keep_latest(_vintages(spark, d), ["panel", "asset", "date"], [F.desc("unit_as_of"), F.desc("value")])
    return latest.select("asset", "date", "unit_as_of", rounded("value", 2).alias("value"))


@book.add("a32_cadence", f"""{with_('panel')},
g AS (SELECT *, date_diff('day', lag(date) OVER (PARTITION BY asset ORDER BY date), date) AS gap FROM panel),
w AS (SELECT asset, count(*) AS n, count(DISTINCT date) AS dates, median(gap) AS gap FROM g GROUP BY asset),
m AS (SELECT asset, median(rows) AS rows FROM (SELECT asset, date_trunc('month', date) AS m, count(*) AS rows FROM panel GROUP BY ALL) GROUP BY asset)
SELECT w.asset, n, n >= 30 AND n = dates AND gap > 0 AND gap <= 3 AND rows >= 8 AS daily FROM w JOIN m ON w.asset = m.asset""")
def a32(spark, d):
    return P.cadence(daily_panel(spark, d))


@book.add("w1_trailing_rows", f"{with_('panel')} SELECT asset, date, row_number() OVER (PARTITION BY asset ORDER BY date DESC) AS age FROM panel QUALIFY age <= 21", dates="date")
def w1(spark, d):
    return P.trailing(daily_panel(spark, d), 21).select("asset", "date", F.col("age").cast("long").alias("age"))


@book.add("w2_w3_lag_lead", f"{with_('panel')} SELECT asset, date, round(lag(value) OVER w, 2) AS before, round(lead(value, 21) OVER w, 2) AS ahead FROM panel WINDOW w AS (PARTITION BY asset ORDER BY date)", dates="date")
def w23(spark, d):
    return daily_panel(spark, d).select("asset", "date", rounded(F.lag("value").over(P.by_date()), 2).alias("before"), rounded(F.lead("value", 21).over(P.by_date()), 2).alias("ahead"))


@book.add("w4_forward_sum", f"{with_('returns')} SELECT asset, date, round(sum(value) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING), 6) AS total FROM returns", dates="date")
def w4(spark, d):
    return return_panel(spark, d).select("asset", "date", rounded(F.sum("value").over(P.by_date().rowsBetween(1, 21))).alias("total"))


@book.add("w5_vol_ratio", f"""{with_('returns')} SELECT asset, date, round(stddev_samp(value) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING)
 / stddev_samp(value) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), 6) AS ratio FROM returns""", dates="date")
def w5(spark, d):
    ahead, back = F.stddev_samp("value").over(P.by_date().rowsBetween(1, 21)), F.stddev_samp("value").over(P.by_date().rowsBetween(-59, 0))
    return return_panel(spark, d).select("asset", "date", rounded(ahead / back).alias("ratio"))


@book.add("w12_trailing_frames", f"""{with_('returns')} SELECT asset, date, round(sum(value) OVER (w ROWS BETWEEN 20 PRECEDING AND CURRENT ROW), 6) AS sum_21,
round(stddev_samp(value) OVER (w ROWS BETWEEN 62 PRECEDING AND CURRENT ROW), 6) AS vol_63, round(value - lag(value, 63) OVER w, 6) AS change_63 FROM returns WINDOW w AS (PARTITION BY asset ORDER BY date)""", dates="date")
def w12(spark, d):
    return return_panel(spark, d).select("asset", "date", rounded(F.sum("value").over(P.by_date().rowsBetween(-20, 0))).alias("sum_21"), rounded(F.stddev_samp("value").over(P.by_date().rowsBetween(-62, 0))).alias("vol_63"), rounded(F.col("value") - F.lag("value", 63).over(P.by_date())).alias("change_63"))


@book.add("w11_g18_card_grid", f"{with_('cards')} SELECT unit_id, as_of, asset, horizon, row_number() OVER (PARTITION BY unit_id ORDER BY asset, horizon) - 1 AS cell FROM cards, (SELECT DISTINCT o_orderpriority AS asset FROM orders), (VALUES (21), (63), (126)) h(horizon)", dates="as_of")
def w11(spark, d):
    assets = table(spark, d, "orders").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("assets"))
    grid = cards(spark, d).crossJoin(F.broadcast(assets)).select("unit_id", "as_of", F.posexplode("assets").alias("a", "asset")).select("*", F.posexplode(F.array(F.lit(21), F.lit(63), F.lit(126))).alias("h", "horizon"))
    return grid.select("unit_id", "as_of", "asset", "horizon", (F.col("a") * 3 + F.col("h")).cast("long").alias("cell"))


@book.add("c1_calendar", f"{with_('panel')} SELECT DISTINCT date, year(date) * 12 + month(date) - 1 AS month_ordinal, isodow(date) - 1 AS weekday, strftime(date, '%Y-%m') AS month FROM panel", dates="date")
def c1(spark, d):
    dates = daily_panel(spark, d).select("date").distinct()
    return dates.select("date", P.month_ordinal(F.col("date")).cast("long").alias("month_ordinal"), F.weekday("date").cast("long").alias("weekday"), F.date_format("date", "yyyy-MM").alias("month"))


def business_day(date, n):
    """The n-th weekday after a date, which first rolls back to a weekday."""
    wd = F.least(F.weekday(date), F.lit(4))
    start = F.date_sub(date, F.weekday(date) - wd)
    ahead = wd + n
    return F.date_add(F.date_sub(start, wd), (F.floor(ahead / 5) * 7 + ahead % 5).cast("int"))


@book.add("c2_business_days", f"""{with_('cards')}, days AS (SELECT unit_id, h, as_of, unnest(generate_series(0, 200)) AS k FROM cards, (VALUES (21), (63), (126)) t(h)),
rolled AS (SELECT *, (as_of - greatest(isodow(as_of) - 5, 0)::INTEGER)::DATE AS start FROM days),
weekdays AS (SELECT unit_id, h, (start + k::INTEGER)::DATE AS target, row_number() OVER (PARTITION BY unit_id, h ORDER BY k) - 1 AS n FROM rolled WHERE isodow((start + k::INTEGER)::DATE) <= 5)
SELECT unit_id, h AS horizon, target FROM weekdays WHERE n = h""", dates="target")
def c2(spark, d):
    c = cards(spark, d).withColumn("horizon", F.explode(F.array(F.lit(21), F.lit(63), F.lit(126))))
    return c.select("unit_id", "horizon", business_day(F.col("as_of"), F.col("horizon")).alias("target"))


@book.add("c3_step_count", f"""{with_('panel')}{SPACING_SQL}, c AS (SELECT asset, h, greatest(round_even(h * 7.0::DOUBLE / 5.0::DOUBLE / spacing, 0)::INTEGER, 1) AS counted FROM spacing, (VALUES (21), (63), (126)) t(h))
SELECT asset, h AS horizon, CASE WHEN greatest(counted, h)::DOUBLE / greatest(least(counted, h), 1) >= 2 THEN counted ELSE h END AS steps FROM c""")
def c3(spark, d):
    s = P.spacing_days(daily_panel(spark, d)).withColumn("horizon", F.explode(F.array(F.lit(21), F.lit(63), F.lit(126))))
    return s.select("asset", "horizon", P.panel_steps_for(F.col("horizon"), F.col("spacing")).alias("steps"))


@book.add("c4_monthly_horizons", f"""{with_('cards')}, p AS (SELECT unit_id, as_of, h, strftime(as_of + to_months(h::INTEGER), '%Y-%m') AS period FROM cards, (VALUES (1), (3), (6)) t(h))
SELECT unit_id, period, (left(period, 4)::INTEGER * 12 + right(period, 2)::INTEGER - 1) - (year(as_of) * 12 + month(as_of) - 1) AS steps,
       count(*) OVER (PARTITION BY unit_id, period) = 1 AS unique_period FROM p""")
def c4(spark, d):
    c = cards(spark, d).withColumn("h", F.explode(F.array(F.lit(1), F.lit(3), F.lit(6)))).withColumn("period", F.date_format(F.add_months("as_of", F.col("h")), "yyyy-MM"))
    target = F.substring("period", 1, 4).cast("int") * 12 + F.substring("period", 6, 2).cast("int") - 1
    return c.select("unit_id", "period", (target - P.month_ordinal(F.col("as_of"))).cast("long").alias("steps"), (F.count("*").over(Window.partitionBy("unit_id", "period")) == 1).alias("unique_period"))


@book.add("c5_instants", """
SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS second, (event_id % 1000000000)::INTEGER AS nanos, (ts::DATE + 1)::DATE AS day_end
FROM events""", dates="day_end")
def c5(spark, d):
    e = table(spark, d, "events")
    text = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad((F.col("event_id") % 1000000000).cast("string"), 9, "0"), F.lit("+02:00"))
    parts = r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)(?:\.(\d{1,9}))?(Z|[+-]\d\d:\d\d)$"
    # the text names an instant two hours earlier; both sides of the contract count from its wall clock
    local = F.unix_seconds(F.to_timestamp(F.regexp_extract(text, parts, 1), "yyyy-MM-dd'T'HH:mm:ss"))
    return e.select("event_id", local.alias("second"), F.rpad(F.regexp_extract(text, parts, 2), 9, "0").cast("int").alias("nanos"), F.date_add(F.to_date("ts"), 1).alias("day_end"))


@book.add("c6_c7_walk_covariance", """
WITH p AS (SELECT s::DOUBLE AS s, t::DOUBLE AS t FROM range(1, 40) a(s), range(1, 40) b(t))
SELECT s::INTEGER AS s, t::INTEGER AS t, least(s, t) AS half, round((pow(s, 1.2) + pow(t, 1.2) - pow(abs(s - t), 1.2)) / 2, 6) AS h06, round(1 / (1 + exp(-(s - t))), 6) AS logistic, sign(s - t)::INTEGER AS sgn FROM p""")
def c67(spark, d):
    s = spark.range(1, 40).select(F.col("id").cast("double").alias("s")).crossJoin(spark.range(1, 40).select(F.col("id").cast("double").alias("t")))
    return s.select(F.col("s").cast("int").alias("s"), F.col("t").cast("int").alias("t"), walk_covariance(F.col("s"), F.col("t"), 0.5).alias("half"), rounded(walk_covariance(F.col("s"), F.col("t"), 0.6)).alias("h06"), rounded(1 / (1 + F.exp(-(F.col("s") - F.col("t"))))).alias("logistic"), F.signum(F.col("s") - F.col("t")).cast("int").alias("sgn"))


def walk_covariance(s, t, hurst: float):
    """Covariance of a fractional walk at two horizons; the lesser of them for a plain random walk."""
    if hurst == 0.5:
        return F.least(s, t)
    return (F.pow(s, F.lit(2 * hurst)) + F.pow(t, F.lit(2 * hurst)) - F.pow(F.abs(s - t), F.lit(2 * hurst))) / 2


@book.add("c8_mean_reverting_variance", """
SELECT n::INTEGER AS n, round(2.0 * n + (5.0 - 2.0) * (1 - pow(0.9, n)) / (1 - 0.9), 6) AS variance FROM range(1, 127) t(n)""")
def c8(spark, d):
    """Sum over n steps of a variance that decays from 5 to 2 by a tenth a step, in closed form."""
    return spark.range(1, 127).select(F.col("id").cast("int").alias("n"), rounded(2.0 * F.col("id") + 3.0 * (1 - F.pow(F.lit(0.9), F.col("id"))) / (1 - 0.9)).alias("variance"))


TERM_SQL = f"""{with_('panel')}{STEPS_SQL}{EWMA_SQL}, v AS (SELECT ew.asset, var_samp(step) AS v_inf, least(greatest(any_value(ewma), 0.25 * var_samp(step)), 4 * var_samp(step)) AS v0 FROM ew JOIN win ON ew.asset = win.asset GROUP BY ew.asset),
path AS (SELECT asset, t, sqrt(greatest(v_inf + (v0 - v_inf) * pow(pow(0.5, 1 / 20.0), t), 1e-18)) AS sig FROM v, range(0, 126) r(t))"""


@book.add("w6_g4_term_structure", f"{TERM_SQL} SELECT a.asset AS asset_a, b.asset AS asset_b, a.t + 1 AS steps, round(sum(a.sig * b.sig) OVER (PARTITION BY a.asset, b.asset ORDER BY a.t) / 1e6, 2) AS cumulative FROM path a JOIN path b ON a.t = b.t")
def w6(spark, d):
    steps = _steps(spark, d)
    v = P.trailing(steps).groupBy("asset").agg(F.var_samp("step").alias("v_inf")).join(P.ewma_variance(steps), "asset")
    v0 = F.least(F.greatest("ewma", 0.25 * F.col("v_inf")), 4 * F.col("v_inf"))
    path = v.withColumn("v0", v0).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(125))))
    path = path.select("asset", "t", F.sqrt(F.greatest(F.col("v_inf") + (F.col("v0") - F.col("v_inf")) * F.pow(F.lit(0.5 ** (1 / 20.0)), F.col("t")), F.lit(1e-18))).alias("sig"))
    pair = path.select(F.col("asset").alias("asset_a"), "t", F.col("sig").alias("sa")).join(path.select(F.col("asset").alias("asset_b"), "t", F.col("sig").alias("sb")), "t")
    total = F.sum(F.col("sa") * F.col("sb")).over(Window.partitionBy("asset_a", "asset_b").orderBy("t"))
    return pair.select("asset_a", "asset_b", (F.col("t") + 1).cast("long").alias("steps"), rounded(total / 1e6, 2).alias("cumulative"))


@book.add("g3_transfer_vol", f"""{with_('panel')}, early AS (SELECT asset, date, value FROM panel WHERE date < DATE '1997-01-01' AND value > 0),
g AS (SELECT asset, ln(value) - lag(ln(value)) OVER w AS step, date_diff('day', lag(date) OVER w, date) AS gap FROM early WINDOW w AS (PARTITION BY asset ORDER BY date)),
l AS (SELECT asset, greatest(10 * median(gap), 5) AS threshold FROM g GROUP BY asset),
v AS (SELECT g.asset, stddev_samp(step) AS log_early, count(step) AS n FROM g JOIN l ON g.asset = l.asset WHERE gap <= threshold GROUP BY g.asset)
SELECT asset, n, round(log_early, 6) AS log_early, CASE WHEN n >= 100 THEN round(sqrt(log_early * 0.5), 6) END AS geo FROM v""")
def g3(spark, d):
    early = daily_panel(spark, d).filter("date < '1997-01-01' and value > 0").withColumn("value", F.log("value"))
    v = P.drop_holes(early).groupBy("asset").agg(F.stddev_samp("step").alias("log_early"), F.count("step").alias("n"))
    return v.select("asset", "n", rounded("log_early").alias("log_early"), F.when(F.col("n") >= 100, rounded(F.sqrt(F.col("log_early") * 0.5))).alias("geo"))


@book.add("o1_o2_sorted_top", f"{with_('panel')} SELECT asset, date, round(value, 2) AS value FROM panel ORDER BY value DESC, asset, date LIMIT 20", dates="date")
def o12(spark, d):
    return daily_panel(spark, d).orderBy(F.desc("value"), "asset", "date").limit(20).select("asset", "date", rounded("value", 2).alias("value"))


@book.add("o4_o9_union_distinct", f"{with_('panel', 'context')} SELECT DISTINCT asset, year(date) AS year FROM (SELECT asset, date FROM panel UNION ALL SELECT asset, date FROM context)")
def o49(spark, d):
    both = daily_panel(spark, d).unionByName(context_panel(spark, d))
    return both.select("asset", F.year("date").cast("long").alias("year")).distinct()


@book.add("o5_o6_sets", """SELECT c_custkey IN (SELECT o_custkey FROM orders) AS has_orders, count(*) AS n FROM customer GROUP BY 1""")
def o56(spark, d):
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    with_orders = c.intersect(o).agg(F.count("*").alias("n")).select(F.lit(True).alias("has_orders"), "n")
    without = c.join(o, "c_custkey", "left_anti").agg(F.count("*").alias("n")).select(F.lit(False).alias("has_orders"), "n")
    return with_orders.unionByName(without).filter("n > 0")


@book.add("o7_hash_sample", """SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey || '|7'), o_orderkey LIMIT 100""")
def o7(spark, d):
    return table(spark, d, "orders").orderBy(F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit("|7")).cast("binary")), "o_orderkey").limit(100).select("o_orderkey")


@book.add("o8_round_robin", """WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS turn FROM orders)
SELECT o_orderkey, o_orderpriority, turn FROM r ORDER BY turn, o_orderpriority LIMIT 40""")
def o8(spark, d):
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    # an asset gives 40 rows at most; the window's group limit stops each sort there
    r = table(spark, d, "orders").withColumn("turn", F.row_number().over(w)).filter("turn <= 40")
    return r.orderBy("turn", "o_orderpriority").limit(40).select("o_orderkey", "o_orderpriority", F.col("turn").cast("long").alias("turn"))
