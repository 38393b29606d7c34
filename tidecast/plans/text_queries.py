"""Queries on documents: corpus scans, tone, novelty, release figures, verification and model-answer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import asof as A
from ..operators import forecast as M
from ..sources.adapters import cards, corpus, draws, table, with_
from .base import Book, rounded

book = Book()
lit = lambda x: "'" + x.replace("'", "''") + "'"


def _count_sql(t: str, phrases: list[str]) -> str:
    return "(" + " + ".join(f"(length({t}) - length(replace({t}, {lit(p)}, ''))) / {len(p)}" for p in phrases) + ")"


#: Short marks stand in for phrases that the invented prose lacks; the phrase lists themselves run beside them.
UPS, DOWNS = ["th", "ion", "en "], ["er", "an ", "ou"]
DOC_SQL = "d AS (SELECT doc_id, text, lower(text) AS t FROM documents)"


@book.add("c12_c13_tone", f"""WITH {DOC_SQL}, c AS (SELECT doc_id, {_count_sql('t', UPS)} AS u, {_count_sql('t', DOWNS)} AS w, {_count_sql('t', X.HAWKISH)} AS h, {_count_sql('t', X.DOVISH)} AS o, {_count_sql('t', X.POSITIVE)} AS p, {_count_sql('t', X.NEGATIVE)} AS n FROM d)
SELECT doc_id, round((u - w) / (u + w + 1), 6) AS balance, round((h - o) / (h + o + 1), 6) AS tone, round((p - n) / (p + n + 1), 6) AS economy FROM c""")
def c12(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = X.balances(docs, "text", balance=(UPS, DOWNS), tone=(X.HAWKISH, X.DOVISH), economy=(X.POSITIVE, X.NEGATIVE))
    return found.select("doc_id", *[rounded(c).alias(c) for c in ("balance", "tone", "economy")])


@book.add("c13_c14_density", f"""WITH {DOC_SQL} SELECT doc_id, round(1000.0 * {_count_sql('t', X.UNCERTAIN)} / greatest(len(regexp_extract_all(t, '[a-z]+')), 1), 6) AS uncertainty, round(100.0 * {_count_sql('t', UPS)} / greatest(len(regexp_extract_all(t, '[a-z]+')), 1), 6) AS density FROM d""")
def c14(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.lower("text").alias("t"))
    return docs.select("doc_id", rounded(X.per_words(F.col("t"), X.UNCERTAIN)).alias("uncertainty"), rounded(X.per_words(F.col("t"), UPS, 100.0)).alias("density"))


PREV_SQL = "p AS (SELECT doc_id, text, lag(text) OVER (PARTITION BY source ORDER BY doc_id) AS prev FROM documents)"
TRI = lambda c: f"list_distinct(list_transform(range(1, len({c}) - 1), lambda i: array_to_string({c}[i:i+2], ' ')))"


def _with_previous(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", "text", F.lag("text").over(Window.partitionBy("source").orderBy("doc_id")).alias("prev"))


@book.add("c15_novelty", f"""WITH {PREV_SQL}, w AS (SELECT doc_id, prev, regexp_extract_all(lower(text), '[a-z]+') AS a, regexp_extract_all(lower(prev), '[a-z]+') AS b FROM p), t AS (SELECT doc_id, prev, {TRI('a')} AS a, {TRI('b')} AS b FROM w)
SELECT doc_id, CASE WHEN prev IS NOT NULL THEN round(1 - len(list_intersect(a, b)) / greatest(len(list_distinct(list_concat(a, b))), 1), 6) END AS novelty FROM t""")
def c15(spark, d):
    # the trigrams of a text are found once and handed on to the text after it
    t = table(spark, d, "documents").select("doc_id", "source", X.trigrams(F.col("text")).alias("a"))
    t = t.withColumn("b", F.lag("a").over(Window.partitionBy("source").orderBy("doc_id")))
    return t.select("doc_id", rounded(X.novelty(F.col("a"), F.col("b"))).alias("novelty"))


@book.add("c16_cosine", f"""WITH {PREV_SQL}, x AS (SELECT doc_id, w, count(*) AS x FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM p WHERE prev IS NOT NULL) GROUP BY ALL), y AS (SELECT doc_id, w, count(*) AS y FROM (SELECT doc_id, unnest(regexp_extract_all(lower(prev), '[a-z]+')) AS w FROM p WHERE prev IS NOT NULL) GROUP BY ALL)
SELECT coalesce(x.doc_id, y.doc_id) AS doc_id, round(sum(coalesce(x, 0) * coalesce(y, 0)) / (sqrt(sum(coalesce(x * x, 0))) * sqrt(sum(coalesce(y * y, 0))) + 1e-12), 6) AS cosine FROM x FULL OUTER JOIN y ON x.doc_id = y.doc_id AND x.w = y.w GROUP BY 1""")
def c16(spark, d):
    return X.cosine(_with_previous(spark, d).filter("prev is not null"), "text", "prev", "doc_id").select("doc_id", rounded("cosine").alias("cosine"))


@book.add("c11_squeeze", r"SELECT doc_id, md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS digest FROM documents")
def c11(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.plain_quotes(F.col("text")).cast("binary")).alias("digest"))


@book.add("s15_content_dedupe", "SELECT md5(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def s15(spark, d):
    return table(spark, d, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@book.add("s9_has_text", "SELECT count(*) FILTER (WHERE length(trim(text)) > 0) AS n FROM documents")
def s9(spark, d):
    from ..sources.files import has_text

    return table(spark, d, "documents").agg(F.count_if(has_text(F.col("text"))).alias("n"))


@book.add("s11_releases_as_of", f"{with_('cards', 'corpus')} SELECT unit_id, count(*) AS n, max(timestamp) AS newest FROM cards JOIN corpus ON timestamp <= as_of WHERE doc_type = 'src2' GROUP BY unit_id", dates="newest")
def s11(spark, d):
    """A running count by day, looked up as of each card."""
    days = corpus(spark, d).filter("doc_type = 'src2'").groupBy("timestamp").agg(F.count("*").alias("here"))
    counts = days.select(F.col("timestamp").alias("newest"), F.sum("here").over(Window.orderBy("timestamp")).alias("n"))  # a row a calendar day
    return A.as_of_join(cards(spark, d), counts, [], "as_of", "newest", ["n"]).filter("n is not null").select("unit_id", "n", "newest")


@book.add("s13_o3_newest_documents", f"{with_('cards', 'corpus')} SELECT unit_id, doc_id, timestamp FROM cards JOIN corpus ON timestamp <= as_of AND timestamp > as_of - 60 WHERE doc_type = 'src4' QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY timestamp DESC, doc_id DESC) <= 2", dates="timestamp")
def s13(spark, d):
    """The newest two of each day first (a limit before the exchange), then the newest two days' rows as of each card."""
    docs = corpus(spark, d).filter("doc_type = 'src4'").select("doc_type", "doc_id", "timestamp")
    of_day = docs.withColumn("rn", F.row_number().over(Window.partitionBy("timestamp").orderBy(F.desc("doc_id")))).filter("rn <= 2")
    ordered = of_day.withColumn("moment", F.struct("timestamp", "doc_id"))
    wanted = cards(spark, d).select("unit_id", "as_of", F.lit("src4").alias("doc_type"), F.struct(F.col("as_of").alias("timestamp"), F.lit((1 << 63) - 1).alias("doc_id")).alias("end"))
    near = A.newest_as_of(wanted, ordered.select("doc_type", "moment"), 2, ["doc_type"], "end", "moment")
    return near.select("unit_id", "moment.doc_id", "moment.timestamp", "as_of").filter(F.col("timestamp") > F.date_sub("as_of", 60)).drop("as_of")


@book.add("c22_positions", f"{with_('draws')} SELECT draw, arg_max(cell, value) AS top_cell, count(*) FILTER (WHERE value > 0) AS positive FROM draws GROUP BY draw")
def c22(spark, d):
    return draws(spark, d).groupBy("draw").agg(F.max_by("cell", "value").alias("top_cell"), F.count_if(F.col("value") > 0).alias("positive"))


@book.add("c24_public_detail", "SELECT c_custkey, 'g1_grid' AS code, CASE WHEN c_acctbal >= 0 THEN 1 ELSE 0 END AS n_counts FROM customer")
def c24(spark, d):
    from ..operators.gates import public_detail

    counts = F.create_map(F.lit("balance"), F.floor("c_acctbal").cast("long"))
    c = table(spark, d, "customer").select("c_custkey", public_detail(F.lit("g1_grid"), counts).alias("p"))
    return c.select("c_custkey", "p.code", F.size("p.counts").alias("n_counts"))


@book.add("a39_g30_tone_validity", f"""{with_('corpus')}, s AS (SELECT timestamp, avg(({_count_sql('lower(text)', UPS)} - {_count_sql('lower(text)', DOWNS)}) / ({_count_sql('lower(text)', UPS)} + {_count_sql('lower(text)', DOWNS)} + 1)) AS tone FROM corpus GROUP BY 1),
c AS (SELECT o_orderdate::DATE AS d, sum(((o_orderkey % 5) - 2) * 25) AS bp FROM orders GROUP BY 1), j AS (SELECT timestamp, any_value(tone) AS tone, coalesce(sum(bp), 0) AS ahead FROM s LEFT JOIN c ON d > timestamp AND d <= timestamp + 90 GROUP BY timestamp) SELECT count(*) AS n, round(corr(tone, ahead), 6) AS corr FROM j""")
def a39(spark, d):
    s = X.balances(corpus(spark, d), "text", tone=(UPS, DOWNS)).groupBy("timestamp").agg(F.avg("tone").alias("tone"))
    c = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.sum((F.col("o_orderkey") % 5 - 2) * 25).alias("bp"))
    ahead = F.sum("bp").over(Window.orderBy(F.datediff("day", F.lit("1970-01-01").cast("date"))).rangeBetween(1, 90))  # a row a calendar day
    days = s.select(F.col("timestamp").alias("day"), "tone", F.lit(0).cast("long").alias("bp"), F.lit(True).alias("said")).unionByName(c.select(F.col("d").alias("day"), F.lit(None).cast("double").alias("tone"), "bp", F.lit(False).alias("said")))
    return days.withColumn("ahead", F.coalesce(ahead, F.lit(0))).filter("said").agg(F.count("*").alias("n"), rounded(F.corr("tone", "ahead")).alias("corr"))


@book.add("m2_token_tone", """WITH p AS (SELECT c_custkey, (c_custkey % 7) / 20.0 AS p1, (c_custkey % 5) / 10.0 AS p3, (c_custkey % 3) / 8.0 AS p5 FROM customer)
SELECT c_custkey, CASE WHEN p1 + p3 + p5 > 0.5 THEN round((p1 + 3 * p3 + 5 * p5) / (p1 + p3 + p5), 6) END AS level, CASE WHEN p1 + p3 + p5 > 0.5 THEN round((p1 - p5) / (p1 + p3 + p5), 6) END AS change FROM p""")
def m2(spark, d):
    k = F.col("c_custkey")
    p = [(k % 7) / 20.0, (k % 5) / 10.0, (k % 3) / 8.0]
    digits = F.create_map(F.lit("1"), p[0], F.lit("3"), p[1], F.lit("5"), p[2])
    letters = F.create_map(F.lit("A"), p[0], F.lit("B"), p[1], F.lit("C"), p[2])
    return table(spark, d, "customer").select("c_custkey", rounded(X.expected_digit(digits)).alias("level"), rounded(X.preference(letters)).alias("change"))


@book.add("g14_overlay_shift", """SELECT c_custkey, round(least(greatest(0.25 * (2 * p - 1), -0.1), 0.1), 6) AS shift FROM (SELECT c_custkey, 1 / (1 + exp(-(c_acctbal / 5000))) AS p FROM customer)""")
def g14s(spark, d):
    return table(spark, d, "customer").select("c_custkey", rounded(M.shift_by_probability(1 / (1 + F.exp(-F.col("c_acctbal") / 5000)))).alias("shift"))
