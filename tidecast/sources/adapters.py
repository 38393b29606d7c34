"""The engine's inputs from general tables: level panels, cards, draws, scores and a dated text corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HORIZONS = (21, 63, 126)
CARD_EVERY = 63
CELLS = 64  # places of a vector


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact_sum(c: str) -> Column:
    """A sum of cents that does not depend on the order of rows."""
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def daily_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, date, value): daily order totals by priority."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("asset"), F.to_date("o_orderdate").alias("date")).agg(exact_sum("o_totalprice").alias("value"))


def context_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, date, value): daily line totals by return flag."""
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy(F.col("l_returnflag").alias("asset"), F.to_date("l_shipdate").alias("date")).agg(exact_sum("l_extendedprice").alias("value"))


def monthly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, date, value): monthly order totals, dated at the month's start."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("asset"), F.trunc("o_orderdate", "MM").alias("date")).agg(exact_sum("o_totalprice").alias("value"))


def return_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, date, value): simple returns of the daily panel."""
    w = Window.partitionBy("asset").orderBy("date")
    p = daily_panel(spark, sf_dir).withColumn("before", F.lag("value").over(w))
    return p.filter("before is not null").select("asset", "date", (F.col("value") / F.col("before") - 1).alias("value"))


def cards(spark: SparkSession, sf_dir: str, every: int = CARD_EVERY) -> DataFrame:
    """(unit_id, as_of): each k-th distinct date of the daily panel."""
    dates = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("as_of")).distinct()
    numbered = dates.withColumn("rn", F.row_number().over(Window.orderBy("as_of")))  # one row a calendar day
    return numbered.filter(F.col("rn") % every == 0).select(F.concat(F.lit("card-"), F.col("as_of").cast("string")).alias("unit_id"), "as_of")


def card_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit_id, as_of, asset): each card's assets, which are those of the panel; their names are one value, so no join makes the grid."""
    names = table(spark, sf_dir, "orders").agg(F.array_sort(F.collect_set("o_orderpriority")))
    return cards(spark, sf_dir).withColumn("asset", F.explode(names.scalar()))


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(draw, cell, asset, horizon, value): a draw for each vector but the last, a cell for each of its places."""
    e = table(spark, sf_dir, "embeddings")
    last = e.agg(F.max("vec_id").alias("last"))
    ranked = e.crossJoin(F.broadcast(last)).filter("vec_id < last").select((F.col("vec_id")).alias("draw"), F.posexplode("embedding").alias("cell", "value"))
    return ranked.select("draw", "cell", F.floor(F.col("cell") / 4).cast("int").alias("asset"), (F.col("cell") % 4).alias("horizon"), F.col("value").cast("double").alias("value"))


def outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, y): the last vector."""
    e = table(spark, sf_dir, "embeddings")
    last = e.agg(F.max_by("embedding", "vec_id").alias("v"))
    return last.select(F.posexplode("v").alias("cell", "y")).withColumn("y", F.col("y").cast("double"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, doc_type, timestamp, text)."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("source").alias("doc_type"), F.date_add(F.lit("1995-01-01").cast("date"), F.pmod(F.col("doc_id") * 7, F.lit(2400)).cast("int")).alias("timestamp"), "text")


#: The same inputs as DuckDB common table expressions.
SQL = {
    "panel": "panel AS (SELECT o_orderpriority AS asset, o_orderdate::DATE AS date, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS value FROM orders GROUP BY ALL)",
    "context": "context AS (SELECT l_returnflag AS asset, l_shipdate::DATE AS date, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS value FROM lineitem GROUP BY ALL)",
    "monthly": "monthly AS (SELECT o_orderpriority AS asset, date_trunc('month', o_orderdate)::DATE AS date, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS value FROM orders GROUP BY ALL)",
    "returns": "returns AS (SELECT asset, date, value / before - 1 AS value FROM (SELECT *, lag(value) OVER (PARTITION BY asset ORDER BY date) AS before FROM panel) WHERE before IS NOT NULL)",
    "cards": f"cards AS (SELECT 'card-' || as_of AS unit_id, as_of FROM (SELECT as_of, row_number() OVER (ORDER BY as_of) AS rn FROM (SELECT DISTINCT o_orderdate::DATE AS as_of FROM orders)) WHERE rn % {CARD_EVERY} = 0)",
    "draws": f"draws AS (SELECT draw, cell, cell // 4 AS asset, cell % 4 AS horizon, value FROM (SELECT vec_id AS draw, unnest(embedding)::DOUBLE AS value, unnest(range({CELLS})) AS cell FROM embeddings WHERE vec_id < (SELECT max(vec_id) FROM embeddings)))",
    "outcome": f"outcome AS (SELECT unnest(v)::DOUBLE AS y, unnest(range({CELLS})) AS cell FROM (SELECT max_by(embedding, vec_id) AS v FROM embeddings))",
    "corpus": "corpus AS (SELECT doc_id, source AS doc_type, (DATE '1995-01-01' + ((doc_id * 7) % 2400)::INTEGER)::DATE AS timestamp, text FROM documents)",
}


def with_(*names: str) -> str:
    """WITH clause of the named inputs, and those they rest on, to go on after a comma."""
    needs = {"returns": ["panel"]}
    out: list[str] = []
    for n in names:
        out += [x for x in (*needs.get(n, ()), n) if x not in out]
    return "WITH " + ",\n".join(SQL[n] for n in out)
