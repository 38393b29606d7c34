"""Queries on draws: scores, gates and roster averages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import gates as G
from ..operators import scoring as S
from ..sources.adapters import CELLS, cards, draws, outcome, table, with_
from .base import Book, rounded

book = Book()
CRPS_SQL = """, ranked AS (SELECT draws.*, y, row_number() OVER (PARTITION BY cell ORDER BY value, draw) AS r, count(*) OVER (PARTITION BY cell) AS m FROM draws JOIN outcome USING (cell)),
c AS (SELECT cell, avg(abs(value - y)) - sum((2 * r - m - 1) * value) / (max(m) * max(m)) AS crps FROM ranked GROUP BY cell)"""
VARIO_SQL = """, e AS (SELECT a.cell AS i, b.cell AS j, avg(sqrt(abs(a.value - b.value))) AS e FROM draws a JOIN draws b ON a.draw = b.draw AND a.cell < b.cell GROUP BY ALL),
v AS (SELECT sum(pow(sqrt(abs(p.y - q.y)) - e, 2)) AS variogram FROM e JOIN outcome p ON p.cell = i JOIN outcome q ON q.cell = j)"""
TAIL_SQL = """, qs AS (SELECT cell, unnest([0.01, 0.05, 0.95, 0.99])::DOUBLE AS level, unnest(quantile_cont(value, [0.01, 0.05, 0.95, 0.99])) AS q FROM draws GROUP BY cell),
t AS (SELECT avg(CASE WHEN y >= q THEN level * (y - q) ELSE (1 - level) * (q - y) END) AS pinball FROM qs JOIN outcome USING (cell))"""


@book.add("a11_k4_quantile_ledger", f"{with_('draws')} SELECT asset, horizon, round(quantile_cont(value, 0.05), 6) AS q05, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.95), 6) AS q95 FROM draws GROUP BY ALL")
def a11(spark, d):
    q = draws(spark, d).groupBy("asset", "horizon").agg(F.expr("percentile(value, array(0.05D, 0.5D, 0.95D))").alias("q"))
    return q.select("asset", "horizon", *[rounded(F.col("q")[i]).alias(n) for i, n in enumerate(("q05", "q50", "q95"))])


@book.add("a12_crps", f"{with_('draws', 'outcome')}{CRPS_SQL} SELECT cell, round(crps, 6) AS crps FROM c")
def a12(spark, d):
    return S.crps(draws(spark, d), outcome(spark, d)).select("cell", rounded("crps").alias("crps"))


@book.add("a13_variogram", f"{with_('draws', 'outcome')}{VARIO_SQL} SELECT round(variogram, 6) AS variogram FROM v")
def a13(spark, d):
    return S.variogram(draws(spark, d), outcome(spark, d)).select(rounded("variogram").alias("variogram"))


@book.add("a14_energy", f"""{with_('draws', 'outcome')}, vec AS (SELECT draw, list(value ORDER BY cell) AS v FROM draws GROUP BY draw), ys AS (SELECT list(y ORDER BY cell) AS y FROM outcome)
SELECT round((SELECT avg(list_distance(v, y)) FROM vec, ys) - (SELECT avg(list_distance(a.v, b.v)) FROM vec a, vec b) / 2, 6) AS energy""")
def a14(spark, d):
    return S.energy(draws(spark, d), outcome(spark, d)).select(rounded("energy").alias("energy"))


@book.add("a15_pinball", f"{with_('draws', 'outcome')}{TAIL_SQL} SELECT round(pinball, 6) AS pinball FROM t")
def a15(spark, d):
    return S.pinball(draws(spark, d), outcome(spark, d)).select(rounded("pinball").alias("pinball"))


@book.add("a16_tail_coverage", f"{with_('draws', 'outcome')}{TAIL_SQL}, s AS (SELECT level, avg((y <= q)::INTEGER) AS share FROM qs JOIN outcome USING (cell) GROUP BY level) SELECT round(sum(abs(share - level)), 6) AS coverage FROM s")
def a16(spark, d):
    return S.coverage(draws(spark, d), outcome(spark, d)).select(rounded("coverage").alias("coverage"))


def _split(spark, d) -> tuple[DataFrame, DataFrame]:
    """Two forecasts of the same cells: the even and the odd draws."""
    x = draws(spark, d)
    return x.filter("draw % 2 = 0"), x.filter("draw % 2 = 1")


def _half(n: int) -> str:
    """The parts of one half of the draws."""
    return f"""h{n} AS (SELECT * FROM draws WHERE draw % 2 = {n}),
r{n} AS (SELECT h{n}.*, y, row_number() OVER (PARTITION BY cell ORDER BY value, draw) AS r, count(*) OVER (PARTITION BY cell) AS m FROM h{n} JOIN outcome USING (cell)),
m{n} AS (SELECT avg(c) AS marginal FROM (SELECT cell, avg(abs(value - y)) - sum((2 * r - m - 1) * value) / (max(m) * max(m)) AS c FROM r{n} GROUP BY cell)),
j{n} AS (SELECT sum(pow(sqrt(abs(p.y - q.y)) - e, 2)) AS joint FROM (SELECT a.cell AS i, b.cell AS j, avg(sqrt(abs(a.value - b.value))) AS e FROM h{n} a JOIN h{n} b ON a.draw = b.draw AND a.cell < b.cell GROUP BY ALL) JOIN outcome p ON p.cell = i JOIN outcome q ON q.cell = j),
q{n} AS (SELECT cell, unnest([0.01, 0.05, 0.95, 0.99])::DOUBLE AS level, unnest(quantile_cont(value, [0.01, 0.05, 0.95, 0.99])) AS q FROM h{n} GROUP BY cell),
t{n} AS (SELECT avg(CASE WHEN y >= q THEN level * (y - q) ELSE (1 - level) * (q - y) END) AS tail FROM q{n} JOIN outcome USING (cell)),
p{n} AS (SELECT marginal, joint, tail FROM m{n}, j{n}, t{n})"""


@book.add("a17_a41_composite", f"""{with_('draws', 'outcome')}, {_half(0)}, {_half(1)}
SELECT round(p0.marginal / p1.marginal, 6) AS marginal, round(p0.joint / p1.joint, 6) AS joint, round(p0.tail / p1.tail, 6) AS tail,
       round(0.5 * p0.marginal / p1.marginal + 0.3 * p0.joint / p1.joint + 0.2 * p0.tail / p1.tail, 6) AS composite FROM p0, p1""")
def a17(spark, d):
    own, base = _split(spark, d)
    y = outcome(spark, d)
    a, b = S.components(own, y), S.components(base, y).select(*[F.col(c).alias(f"ref_{c}") for c in ("marginal", "joint", "tail")])
    ratio = {c: F.col(c) / F.col(f"ref_{c}") for c in ("marginal", "joint", "tail")}
    r = a.crossJoin(b).select("cells", *[v.alias(k) for k, v in ratio.items()])
    return r.select(*[rounded(c).alias(c) for c in ratio], rounded(S.composite(F.col("marginal"), F.col("joint"), F.col("tail"), F.col("cells"))).alias("composite"))


SCORES_SQL = "scores AS (SELECT 'unit-' || o_custkey AS unit_id, o_orderpriority AS family, year(min(o_orderdate)) AS year, avg(o_totalprice) / 150000 AS score FROM orders GROUP BY ALL)"


def scores(spark, d) -> DataFrame:
    """A table of scores: (unit_id, family, year, score) by customer and priority."""
    o = table(spark, d, "orders")
    return o.groupBy(F.concat(F.lit("unit-"), "o_custkey").alias("unit_id"), F.col("o_orderpriority").alias("family")).agg(F.year(F.min("o_orderdate")).cast("long").alias("year"), (F.avg("o_totalprice") / 150000).alias("score"))


@book.add("a18_j11_roster_mean", """WITH s AS (SELECT o_custkey AS k, avg(o_totalprice) / 150000 AS score FROM orders WHERE o_custkey % 7 <> 0 GROUP BY k),
j AS (SELECT c_custkey, s.score, c_custkey IS NOT NULL AS own FROM (SELECT c_custkey FROM customer WHERE c_custkey % 11 <> 0) c FULL OUTER JOIN s ON k = c_custkey)
SELECT count(*) FILTER (WHERE own) AS units, count(*) FILTER (WHERE own AND score IS NULL) AS failed, count(*) FILTER (WHERE NOT own) AS unexpected,
round(avg(least(greatest(coalesce(score, 4.0), 0.0), 4.0)) FILTER (WHERE own), 6) AS mean FROM j""")
def a18(spark, d):
    """Units without a score have failed: here those of every seventh customer, which is the case in point."""
    roster = table(spark, d, "customer").filter("c_custkey % 11 <> 0").select(F.col("c_custkey").alias("unit_id"))
    s = table(spark, d, "orders").filter("o_custkey % 7 <> 0").groupBy(F.col("o_custkey").alias("unit_id")).agg((F.avg("o_totalprice") / 150000).alias("score"))
    return G.roster_mean(roster, s).withColumn("mean", rounded("mean"))


@book.add("a19_mixed_modes", """SELECT o_orderstatus AS submission, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS other_mode, count(*) FILTER (WHERE o_orderpriority = '5-LOW') > 0 AS refused FROM orders GROUP BY 1""")
def a19(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("submission"), F.when(F.col("o_orderpriority") == "5-LOW", "raw").otherwise("ref_scale").alias("mode"))
    n = F.count_if(F.col("mode") != "ref_scale")
    return o.groupBy("submission").agg(n.alias("other_mode"), (n > 0).alias("refused"))


@book.add("a20_grouped_scores", f"WITH {SCORES_SQL} SELECT family, year, count(*) AS n, round(avg(score), 6) AS mean, round(median(score), 6) AS mid, count(*) FILTER (WHERE score > 1.5) AS clipped, round(avg(score) FILTER (WHERE score < 1), 6) AS low_mean FROM scores GROUP BY family, year")
def a20(spark, d):
    return scores(spark, d).groupBy("family", "year").agg(F.count("*").alias("n"), rounded(F.avg("score")).alias("mean"), rounded(F.median("score")).alias("mid"), F.count_if(F.col("score") > 1.5).alias("clipped"), rounded(F.avg(F.when(F.col("score") < 1, F.col("score")))).alias("low_mean"))


@book.add("a36_width_and_shift", f"""{with_('draws')}, q AS (SELECT cell, draw % 2 AS half, quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.95) AS c FROM draws GROUP BY ALL)
SELECT x.cell, round((x.c - x.a) / (y.c - y.a), 6) AS width_ratio, round((x.b - y.b) / (y.c - y.a), 6) AS shift FROM q x JOIN q y ON x.cell = y.cell AND x.half = 0 AND y.half = 1""")
def a36(spark, d):
    q = lambda x, p: x.groupBy("cell").agg(F.expr("percentile(value, array(0.05D, 0.5D, 0.95D))").alias(p))
    own, base = _split(spark, d)
    j = q(own, "x").join(q(base, "y"), "cell")
    width = F.col("y")[2] - F.col("y")[0]
    return j.select("cell", rounded((F.col("x")[2] - F.col("x")[0]) / width).alias("width_ratio"), rounded((F.col("x")[1] - F.col("y")[1]) / width).alias("shift"))


@book.add("a37_summary", f"WITH {SCORES_SQL} SELECT count(*) AS n, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS sd, round(min(score), 6) AS low, round(quantile_cont(score, 0.25), 6) AS q25, round(median(score), 6) AS q50, round(quantile_cont(score, 0.75), 6) AS q75, round(max(score), 6) AS high FROM scores")
def a37(spark, d):
    q = F.expr("percentile(score, array(0.25D, 0.5D, 0.75D))")
    return scores(spark, d).agg(F.count("*").alias("n"), rounded(F.avg("score")).alias("mean"), rounded(F.stddev_samp("score")).alias("sd"), rounded(F.min("score")).alias("low"), rounded(q[0]).alias("q25"), rounded(q[1]).alias("q50"), rounded(q[2]).alias("q75"), rounded(F.max("score")).alias("high"))


BROKEN_SQL = f"""{with_('draws')}, broken AS (SELECT 'sound' AS kind, draw, cell, value FROM draws UNION ALL SELECT 'duplicate', draw, cell, value FROM draws UNION ALL SELECT 'duplicate', draw, cell, value FROM draws WHERE draw % 50 = 0
UNION ALL SELECT 'dropped', draw, cell, value FROM draws WHERE (draw + cell) % 40 <> 0 UNION ALL SELECT 'nan', draw, cell, CASE WHEN draw % 60 = 1 THEN 'nan'::DOUBLE WHEN draw % 60 = 2 THEN NULL WHEN draw % 60 = 3 THEN 'inf'::DOUBLE ELSE value END FROM draws
UNION ALL SELECT 'unknown', draw, CASE WHEN draw % 70 = 0 THEN cell + 100 ELSE cell END, value FROM draws)"""


def broken(spark, d) -> DataFrame:
    """(kind, draw, cell, value): a sound set of draws and four broken ones."""
    x = draws(spark, d).select("draw", "cell", "value")
    k = lambda df, kind: df.select(F.lit(kind).alias("kind"), "draw", "cell", "value")
    odd = F.when(F.col("draw") % 60 == 1, float("nan")).when(F.col("draw") % 60 == 2, None).when(F.col("draw") % 60 == 3, float("inf")).otherwise(F.col("value"))
    return (
        k(x, "sound").unionByName(k(x, "duplicate")).unionByName(k(x.filter("draw % 50 = 0"), "duplicate"))
        .unionByName(k(x.filter("(draw + cell) % 40 <> 0"), "dropped")).unionByName(k(x.withColumn("value", odd), "nan"))
        .unionByName(k(x.withColumn("cell", F.when(F.col("draw") % 70 == 0, F.col("cell") + 100).otherwise(F.col("cell"))), "unknown"))
    )


@book.add("f7_finite", f"{BROKEN_SQL} SELECT kind, count(*) AS n, count(*) FILTER (WHERE value IS NULL) AS n_null, count(*) FILTER (WHERE NOT isfinite(value)) AS n_not_finite FROM broken GROUP BY kind")
def f7(spark, d):
    return G.finite_counts(broken(spark, d), ["kind"])


@book.add("a31_occupancy", f"{BROKEN_SQL}, n AS (SELECT max(draw) + 1 AS n FROM draws), f AS (SELECT kind, draw, cell, count(*) AS c FROM broken, n WHERE cell < {CELLS} GROUP BY ALL) SELECT kind, count(*) FILTER (WHERE c > 1) AS duplicated, (SELECT n FROM n) * {CELLS} - count(*) AS missing FROM f GROUP BY kind")
def a31(spark, d):
    n = table(spark, d, "embeddings").agg(F.max("vec_id")).first()[0]  # ids run from 0; the last is the outcome
    return G.occupancy(broken(spark, d), ["kind"], n, CELLS)


@book.add("f10_unknown_cells", f"{BROKEN_SQL} SELECT kind, count(*) AS unknown FROM broken WHERE cell >= {CELLS} GROUP BY kind")
def f10(spark, d):
    return G.unknown_cells(broken(spark, d), spark.range(CELLS).select(F.col("id").cast("int").alias("cell")), ["kind"])


@book.add("f8_gates", f"""{BROKEN_SQL}, n AS (SELECT max(draw) + 1 AS n FROM draws), g AS (SELECT kind, count(*) FILTER (WHERE cell >= {CELLS}) AS unknown, count(*) FILTER (WHERE value IS NULL OR NOT isfinite(value)) AS bad, count(*) AS rows FROM broken GROUP BY kind)
SELECT kind, CASE WHEN unknown > 0 THEN 'g1_grid' WHEN bad > 0 THEN 'g2_finite' WHEN rows <> (SELECT n FROM n) * {CELLS} THEN 'g3_occupancy' END AS failure FROM g""")
def f8(spark, d):
    n = table(spark, d, "embeddings").agg(F.max("vec_id")).first()[0]
    g = broken(spark, d).groupBy("kind").agg(F.count_if(F.col("cell") >= CELLS).alias("unknown"), F.count_if(~G.is_finite(F.col("value"))).alias("bad"), F.count("*").alias("rows"))
    return g.select("kind", G.first_failure([("g1_grid", F.col("unknown") > 0), ("g2_finite", F.col("bad") > 0), ("g3_occupancy", F.col("rows") != n * CELLS)]).alias("failure"))


GRIDS_SQL = "grids AS (SELECT o_orderkey AS k, [o_custkey % 5, o_custkey % 3 + 2, 7] AS declared, [o_custkey % 5, 4, 7] AS expected FROM orders)"


@book.add("f9_declared_grid", f"WITH {GRIDS_SQL} SELECT k, declared = expected AS equal, len(list_filter(list_distinct(expected), lambda x: NOT list_contains(declared, x))) AS missing, len(list_filter(list_distinct(declared), lambda x: NOT list_contains(expected, x))) AS extra, len(declared) - len(list_distinct(declared)) AS repeated FROM grids")
def f9(spark, d):
    k = F.col("o_custkey")
    seven, four = F.lit(7).cast("long"), F.lit(4).cast("long")
    g = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), G.declared_grid(F.array(k % 5, k % 3 + 2, seven), F.array(k % 5, four, seven)).alias("g"))
    return g.select("k", "g.equal", *[F.col(f"g.{c}").cast("long").alias(c) for c in ("missing", "extra", "repeated")])


@book.add("f24_grid_axes", "SELECT o_orderkey AS k, CASE WHEN o_custkey % 3 = 1 AND o_custkey % 4 = 0 THEN 'repeated' WHEN o_custkey % 3 = 1 THEN 'repeated' WHEN o_custkey % 4 = 0 THEN 'not_positive' END AS fault FROM orders")
def f24(spark, d):
    assets = F.array(F.lit("a"), F.when(F.col("o_custkey") % 3 == 1, "a").otherwise("b"))
    horizons = F.array((F.col("o_custkey") % 4).cast("int"), F.lit(21))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), G.axis_faults(assets, horizons).alias("fault"))


@book.add("f11_metadata_binding", f"""{with_('cards')}, meta AS (SELECT unit_id, CASE WHEN day(as_of) % 5 = 0 THEN NULL ELSE as_of END AS m, CASE WHEN day(as_of) % 7 = 0 THEN 'level' ELSE 'log_return' END AS target FROM cards WHERE month(as_of) <> 6)
SELECT cards.unit_id, meta.unit_id IS NOT NULL AS present, meta.m IS NOT DISTINCT FROM as_of AS as_of_ok, target IS NOT DISTINCT FROM 'log_return' AS target_ok FROM cards LEFT JOIN meta ON cards.unit_id = meta.unit_id""")
def f11(spark, d):
    c = cards(spark, d)
    meta = c.filter(F.month("as_of") != 6).select("unit_id", F.when(F.day("as_of") % 5 != 0, F.col("as_of")).alias("m"), F.when(F.day("as_of") % 7 == 0, "level").otherwise("log_return").alias("target"), F.lit(True).alias("present"))
    return c.join(meta, "unit_id", "left").select("unit_id", F.coalesce("present", F.lit(False)).alias("present"), F.col("m").eqNullSafe(F.col("as_of")).alias("as_of_ok"), F.col("target").eqNullSafe(F.lit("log_return")).alias("target_ok"))


@book.add("f14_target_dates", f"{with_('cards')} SELECT unit_id, day(as_of) > 3 AS sane FROM cards")
def f14(spark, d):
    targets = F.array(F.date_add("as_of", 21), F.when(F.day("as_of") > 3, F.date_add("as_of", 1)).otherwise(F.col("as_of")), F.date_add("as_of", 126))
    return cards(spark, d).select("unit_id", F.forall(targets, lambda x: x > F.col("as_of")).alias("sane"))


@book.add("f17_split_and_shock", f"WITH {SCORES_SQL}, q AS (SELECT quantile_cont(score, 0.67) AS q FROM scores) SELECT unit_id, family, year < 1998 AS train, score >= q AS shock FROM scores, q")
def f17(spark, d):
    s = scores(spark, d)
    q = s.agg(F.expr("percentile(score, 0.67D)").alias("q"))
    return s.crossJoin(F.broadcast(q)).select("unit_id", "family", (F.col("year") < 1998).alias("train"), (F.col("score") >= F.col("q")).alias("shock"))


@book.add("f20_scale_validation", """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'keys' WHEN c_acctbal <= 0 THEN 'not_positive' WHEN c_custkey % 3 = 0 THEN 'joint_missing' END AS fault FROM customer""")
def f20(spark, d):
    scale = F.map_filter(F.create_map(F.lit("marginal"), F.col("c_acctbal"), F.lit("tail"), F.lit(1.0), F.lit("joint"), F.when(F.col("c_custkey") % 3 != 0, 2.0), F.when(F.col("c_custkey") % 5 == 0, "other").otherwise("tail2"), F.when(F.col("c_custkey") % 5 == 0, 1.0)), lambda k, v: v.isNotNull())
    allowed = F.array(*map(F.lit, ("marginal", "joint", "tail")))
    fault = F.when(F.size(F.array_except(F.map_keys(scale), allowed)) > 0, "keys").when(~F.forall(F.map_values(scale), lambda v: (v > 0) & G.is_finite(v)), "not_positive").when(~F.map_contains_key(scale, "joint"), "joint_missing")
    return table(spark, d, "customer").select("c_custkey", fault.alias("fault"))


@book.add("s4_s5_exact_rows", """SELECT t.name, n AS n_rows, c AS n_columns, n AS counted, CASE WHEN n > 1000 THEN 'rows' WHEN c > 6 THEN 'columns' END AS fault FROM
(SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'nation', count(*) FROM nation) t JOIN (SELECT table_name AS name, count(*) AS c FROM information_schema.columns GROUP BY 1) i ON t.name = i.name""")
def s45(spark, d):
    from ..sources.files import inspect_parquet

    out = None
    for name in ("orders", "lineitem", "nation"):
        facts = inspect_parquet(spark, f"{d}/{name}.parquet", max_rows=1000, max_columns=6)
        one = facts.agg(F.sum("n_rows").alias("n_rows"), F.max("n_columns").cast("long").alias("n_columns"), F.max("fault").alias("fault")).crossJoin(table(spark, d, name).agg(F.count("*").alias("counted"))).withColumn("name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("name", "n_rows", "n_columns", "counted", "fault")


@book.add("s6_exact_columns", "SELECT count(*) AS n, round(sum(c_acctbal::DECIMAL(18,2))::DOUBLE, 2) AS total FROM customer")
def s6(spark, d):
    from ..sources.files import read_exact

    c = read_exact(table(spark, d, "customer"), ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], keep=["c_acctbal"])
    return c.agg(F.count("*").alias("n"), F.round(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double"), 2).alias("total"))


@book.add("a33_regret", f"""WITH {SCORES_SQL}, t AS (SELECT family AS level, (hash_year % 3) AS candidate, avg(score) AS s FROM (SELECT *, year AS hash_year FROM scores) GROUP BY ALL), r AS (SELECT *, s - min(s) OVER (PARTITION BY level) AS regret FROM t),
w AS (SELECT candidate, max(regret) AS worst FROM r GROUP BY candidate) SELECT candidate, round(worst, 6) AS worst, worst = min(worst) OVER () AS minimax FROM w""")
def a33(spark, d):
    t = scores(spark, d).groupBy(F.col("family").alias("level"), (F.col("year") % 3).alias("candidate")).agg(F.avg("score").alias("s"))
    worst = t.withColumn("regret", F.col("s") - F.min("s").over(Window.partitionBy("level"))).groupBy("candidate").agg(F.max("regret").alias("worst"))
    best = worst.agg(F.min("worst").alias("best"))
    return worst.crossJoin(F.broadcast(best)).select("candidate", rounded("worst").alias("worst"), (F.col("worst") == F.col("best")).alias("minimax"))


@book.add("a34_a35_leave_one_year_out", f"""WITH {SCORES_SQL}, t AS (SELECT year, family AS candidate, sum(score) AS s, count(*) AS n FROM scores GROUP BY ALL), a AS (SELECT candidate, sum(s) AS s, sum(n) AS n FROM t GROUP BY candidate),
o AS (SELECT t.year, t.candidate, (a.s - t.s) / (a.n - t.n) AS other, t.s / t.n AS own FROM t JOIN a ON t.candidate = a.candidate WHERE a.n > t.n)
SELECT year, candidate, round(own, 6) AS held_out FROM o QUALIFY row_number() OVER (PARTITION BY year ORDER BY other, candidate) = 1""")
def a34(spark, d):
    t = scores(spark, d).groupBy("year", F.col("family").alias("candidate")).agg(F.sum("score").alias("s"), F.count("*").alias("n"))
    whole = Window.partitionBy("candidate")  # totals less the year's own: no pass over the scores for each year
    o = t.withColumn("other", (F.sum("s").over(whole) - F.col("s")) / F.nullif(F.sum("n").over(whole) - F.col("n"), F.lit(0))).filter("other is not null")
    best = o.groupBy("year").agg(F.min_by(F.struct("candidate", "s", "n"), F.struct("other", "candidate")).alias("b"))
    return best.select("year", "b.candidate", rounded(F.col("b.s") / F.col("b.n")).alias("held_out"))
