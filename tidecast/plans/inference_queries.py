"""Queries on scores and labels: resampling, ranks, tests and fitted models."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import inference as I
from ..sources.adapters import table
from .base import Book, rounded
from .score_queries import SCORES_SQL, scores

book = Book()
U = lambda k: f"('0x' || substr(md5({k}), 1, 8))::BIGINT / 4294967296.0"

MONTHS_SQL = "r AS (SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m') AS month, o_totalprice / 1000 AS v, (o_totalprice - 2 * o_custkey) / 1000 AS dv FROM orders)"


def _months(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), (F.col("o_totalprice") / 1000).alias("v"), ((F.col("o_totalprice") - 2 * F.col("o_custkey")) / 1000).alias("dv"))


def _bootstrap_sql(value: str, cluster: str, rows: str = MONTHS_SQL) -> str:
    return f"""WITH {rows}, s AS (SELECT {cluster} AS c, sum({value}) AS s, count({value}) AS n FROM r GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY c) - 1 AS k, count(*) OVER () AS m FROM s),
dr AS (SELECT b, floor({U("b || '|' || k")} * m)::BIGINT AS k FROM k, range(1, 201) t(b)),
x AS (SELECT b, sum(s) / sum(n) AS x FROM dr JOIN k ON dr.k = k.k GROUP BY b)
SELECT round((SELECT sum(s) / sum(n) FROM s), 4) AS mean, round(quantile_cont(x, 0.025), 4) AS low, round(quantile_cont(x, 0.975), 4) AS high FROM x"""


def _four(df: DataFrame) -> DataFrame:
    return df.select(*[rounded(c, 4).alias(c) for c in df.columns])


@book.add("a21_cluster_bootstrap", _bootstrap_sql("v", "month"))
def a21(spark, d):
    return _four(I.cluster_bootstrap(_months(spark, d), "month", "v"))


@book.add("a22_paired_bootstrap", _bootstrap_sql("dv", "month"))
def a22(spark, d):
    return _four(I.cluster_bootstrap(_months(spark, d), "month", "dv"))


_STEPS = [sum(math.exp(-1) / math.factorial(i) for i in range(n + 1)) for n in range(I.POISSON_MOST)]
_TIMES = " + ".join(f"(u >= {x!r})::INTEGER" for x in _STEPS)


@book.add("a23_row_bootstrap", f"""WITH e AS (SELECT b, c_acctbal AS v, {U("b || '|' || c_custkey")} AS u FROM customer, range(1, 201) t(b)), w AS (SELECT b, v, {_TIMES} AS w FROM e), x AS (SELECT b, sum(w * v) / sum(w) AS x FROM w GROUP BY b)
SELECT round((SELECT avg(c_acctbal) FROM customer), 4) AS mean, round(quantile_cont(x, 0.025), 4) AS low, round(quantile_cont(x, 0.975), 4) AS high FROM x""")
def a23(spark, d):
    return _four(I.row_bootstrap(table(spark, d, "customer"), "c_acctbal", "c_custkey"))


RANKS_SQL = "c AS (SELECT c_custkey AS k, round(c_acctbal, -2) AS x, c_nationkey::DOUBLE AS y, length(c_name) + c_custkey % 17 AS z FROM customer), rk AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2 AS r{v}" for v in "xyz") + " FROM c)"


def _customers(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.round("c_acctbal", -2).alias("x"), F.col("c_nationkey").cast("double").alias("y"), (F.length("c_name") + F.col("c_custkey") % 17).alias("z"))


@book.add("a24_w10_spearman", f"WITH {RANKS_SQL}, q AS (SELECT corr(rx, ry) AS xy, corr(rx, rz) AS xz, corr(ry, rz) AS yz FROM rk) SELECT round(xy, 6) AS rho, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS partial FROM q")
def a24(spark, d):
    s = I.spearman(_customers(spark, d), "x", "y", "z")
    return s.select(rounded("rho").alias("rho"), rounded("partial").alias("partial"))


@book.add("a25_w13_permutation", f"""WITH c AS (SELECT c_custkey AS k, c_acctbal AS x, (c_nationkey + c_custkey % 7)::DOUBLE AS y, c_mktsegment AS g FROM customer), p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY k) AS place FROM c),
m AS (SELECT * FROM p, range(1, 100) t(b)), w AS (SELECT b, g, y, row_number() OVER (PARTITION BY b, g ORDER BY {U("b || '|' || k")}, k) AS place FROM m),
e AS (SELECT m.b, corr(m.x, w.y) AS r FROM m JOIN w ON m.b = w.b AND m.g = w.g AND m.place = w.place GROUP BY m.b), o AS (SELECT corr(x, y) AS r FROM c)
SELECT round(o.r, 6) AS observed, count(*) FILTER (WHERE abs(e.r) >= abs(o.r)) AS exceed, (count(*) FILTER (WHERE abs(e.r) >= abs(o.r)) + 1) / 100.0 AS p FROM e, o GROUP BY o.r""")
def a25(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x"), (F.col("c_nationkey") + F.col("c_custkey") % 7).cast("double").alias("y"), F.col("c_mktsegment").alias("g"))
    return I.permutation_test(c, "x", "y", "g", "k").withColumn("observed", rounded("observed"))


@book.add("a26_w7_holm", """WITH t AS (SELECT n_nationkey AS k, ((n_nationkey * 37) % 101) / 1500.0 AS p FROM nation), s AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, k) + 1) * p) AS a FROM t)
SELECT k, round(p, 9) AS p, round(max(a) OVER (ORDER BY p, k ROWS UNBOUNDED PRECEDING), 9) AS adjusted FROM s""")
def a26(spark, d):
    t = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), (((F.col("n_nationkey") * 37) % 101) / 1500.0).alias("p"))
    return I.holm(t, "p", "k").select("k", rounded("p", 9).alias("p"), rounded("adjusted", 9).alias("adjusted"))


LABELLED_SQL = "l AS (SELECT doc_id, n_chars::DOUBLE AS n, length(text) - length(replace(text, ' ', '')) AS spaces, length(regexp_replace(text, '[^#*$%&|]', '', 'g')) AS symbols, quality FROM labels JOIN documents USING (doc_id))"


def labelled(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n"), (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).alias("spaces"), F.length(F.regexp_replace("text", "[^#*$%&|]", "")).alias("symbols"))
    return table(spark, d, "labels").join(docs, "doc_id").select("doc_id", "n", "spaces", "symbols", "quality")


@book.add("a27_auc", f"WITH {LABELLED_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY -symbols, doc_id) AS r FROM l), c AS (SELECT sum(quality) AS n1, count(*) - sum(quality) AS n0, sum(r) FILTER (WHERE quality = 1) AS s FROM r) SELECT round((s - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS auc FROM c")
def a27(spark, d):
    return I.auc(labelled(spark, d).withColumn("score", -F.col("symbols")), "score", "quality", "doc_id").select(rounded("auc").alias("auc"))


@book.add("a28_hit_rates", f"""WITH {LABELLED_SQL} SELECT CASE WHEN n < 800 THEN 'low' WHEN n < 3000 THEN 'mid' ELSE 'high' END AS bucket, count(*) AS n, round(avg(((symbols < 20)::INTEGER = quality)::INTEGER), 6) AS hit FROM l GROUP BY 1""")
def a28(spark, d):
    bucket = F.when(F.col("n") < 800, "low").when(F.col("n") < 3000, "mid").otherwise("high")
    hit = ((F.col("symbols") < 20).cast("int") == F.col("quality")).cast("int")
    return labelled(spark, d).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), rounded(F.avg(hit)).alias("hit"))


@book.add("a38_precision_recall", f"WITH {LABELLED_SQL} SELECT count(*) FILTER (WHERE symbols < 20) AS accepted, count(*) FILTER (WHERE symbols < 20 AND quality = 1) AS correct, count(*) FILTER (WHERE quality = 0) AS negatives, round(count(*) FILTER (WHERE symbols < 20 AND quality = 1) / count(*) FILTER (WHERE quality = 1), 6) AS recall FROM l")
def a38(spark, d):
    ok, good = F.col("symbols") < 20, F.col("quality") == 1
    return labelled(spark, d).agg(F.count_if(ok).alias("accepted"), F.count_if(ok & good).alias("correct"), F.count_if(~good).alias("negatives"), rounded(F.count_if(ok & good) / F.count_if(good)).alias("recall"))


@book.add("a29_logistic")
def a29(spark, d):
    """Newton steps have no SQL form; the fit is tested against one in numpy."""
    rows = labelled(spark, d).withColumn("share", F.col("symbols") / F.greatest("n", F.lit(1.0))).withColumn("gaps", F.col("spaces") / F.greatest("n", F.lit(1.0)))
    m = I.logistic(rows, ["share", "gaps"], "quality")
    return rows.select("doc_id", "quality", rounded(I.logistic_probability(m, [F.col("share"), F.col("gaps")])).alias("probability"))


@book.add("a40_run_summary", """SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(max(value), 4) AS high, count(*) FILTER (WHERE value > 50) AS slow, count(DISTINCT user_id) AS users FROM events GROUP BY event_type""")
def a40(spark, d):
    q = F.expr("percentile(value, array(0.5D, 0.95D))")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), rounded(q[0], 4).alias("p50"), rounded(q[1], 4).alias("p95"), rounded(F.max("value"), 4).alias("high"), F.count_if(F.col("value") > 50).alias("slow"), F.countDistinct("user_id").alias("users"))


@book.add("j9_j10_inner_joins", f"""WITH {SCORES_SQL}, a AS (SELECT unit_id, family, score FROM scores WHERE year < 2000), b AS (SELECT unit_id, family, score * 1.01 AS score FROM scores WHERE year > 1996)
SELECT a.family, count(*) AS n, round(avg(b.score - a.score), 6) AS difference FROM a JOIN b ON a.unit_id = b.unit_id AND a.family = b.family GROUP BY a.family""")
def j9(spark, d):
    s = scores(spark, d)
    a = s.filter("year < 2000").select("unit_id", "family", F.col("score").alias("a"))
    b = s.filter("year > 1996").select("unit_id", "family", (F.col("score") * 1.01).alias("b"))
    return a.join(b, ["unit_id", "family"]).groupBy("family").agg(F.count("*").alias("n"), rounded(F.avg(F.col("b") - F.col("a"))).alias("difference"))


@book.add("g17_confidence_shift", f"WITH {SCORES_SQL} SELECT unit_id, family, (CASE WHEN score < 0.5 THEN 0.0 WHEN score < 1 THEN 0.1 ELSE 0.25 END)::DOUBLE AS k FROM scores")
def g17(spark, d):
    return scores(spark, d).select("unit_id", "family", F.when(F.col("score") < 0.5, 0.0).when(F.col("score") < 1, 0.1).otherwise(0.25).alias("k"))


@book.add("g22_shock_sets", f"""WITH {SCORES_SQL}, z AS (SELECT *, abs(score - avg(score) OVER (PARTITION BY family)) / stddev_samp(score) OVER (PARTITION BY family) AS z FROM scores), u AS (SELECT unit_id, max(z) AS z FROM z GROUP BY unit_id), c AS (SELECT quantile_cont(z, 0.9) AS cut FROM u)
SELECT unit_id, round(z, 6) AS z FROM u, c WHERE z >= cut""")
def g22(spark, d):
    w = Window.partitionBy("family")
    z = scores(spark, d).withColumn("z", F.abs(F.col("score") - F.avg("score").over(w)) / F.stddev_samp("score").over(w)).groupBy("unit_id").agg(F.max("z").alias("z"))
    return z.crossJoin(F.broadcast(z.agg(F.expr("percentile(z, 0.9D)").alias("cut")))).filter("z >= cut").select("unit_id", rounded("z").alias("z"))
