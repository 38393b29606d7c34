"""Dated document collections: statements of a corpus, and the packets that a reader of a card is given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# The type of a statement, the date in its file's name, and how much of it is read.
STATEMENT = "fomc_statement"
FILE_DATE = r"(\d{4})[-_]?(\d{2})[-_]?(\d{2})"
STATEMENT_CHARS = 8000
#: Characters of a document and of a packet.
PER_DOC, PER_PACKET = 4000, 14_000


def statements(files: DataFrame, index: DataFrame) -> DataFrame:
    """(unit, date, file, text): a unit's statements by its index (unit, file, doc_type, timestamp), or, where that lists none, by the dates in the
    names of its files (unit, file, text). A unit is never read both ways."""
    by_name = F.contains("file", F.lit(STATEMENT))
    listed = index.filter((F.col("doc_type") == STATEMENT) | by_name).select("unit", "file", F.to_date(F.substring(F.col("timestamp").cast("string"), 1, 10)).alias("date"))
    part = lambda i: F.regexp_extract("file", FILE_DATE, i)
    named = files.filter(by_name & F.rlike("file", F.lit(FILE_DATE))).select("unit", "file", F.to_date(F.concat_ws("-", part(1), part(2), part(3))).alias("date"))
    chosen = listed.unionByName(named.join(listed.select("unit").distinct(), "unit", "left_anti"))
    return chosen.join(files, ["unit", "file"]).select("unit", "date", "file", X.squeeze(F.substring("text", 1, STATEMENT_CHARS)).alias("text"))


def within_budget(docs: DataFrame, unit: str, newest: list[Column], per_doc: int = PER_DOC, budget: int = PER_PACKET) -> DataFrame:
    """docs (unit, text, ...) with place and body: the first per_doc characters of each, newest first, as far as the unit's budget goes; the one
    that crosses it is cut, none follows. A document takes a character at least, so no more than budget documents of a unit pass the exchange."""
    w = Window.partitionBy(unit).orderBy(*newest)
    some = docs.filter(F.length("text") > 0).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= budget)
    before = F.coalesce(F.sum(F.least(F.length("text"), F.lit(per_doc))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = some.withColumn("__left", budget - before).filter(F.col("__left") > 0)
    return left.withColumn("body", F.substring(F.col("text"), F.lit(1), F.least(F.lit(per_doc), F.col("__left").cast("int")))).drop("__left")


def packets(docs: DataFrame, as_of: Column, masked: bool) -> DataFrame:
    """(unit, n_docs, packet): the documents of docs (unit, doc_type, timestamp, place, body) in order, each under its type and date. Masked, the
    date is told in days before the as-of date, and the text is masked."""
    when = F.concat(F.lit("T-"), F.datediff(as_of, "timestamp").cast("string"), F.lit(" calendar days")) if masked else F.col("timestamp").cast("string")
    body = X.mask(F.col("body")) if masked else F.col("body")
    one = F.concat(F.lit("doc_type: "), F.col("doc_type"), F.lit("\ndate: "), when, F.lit("\n\n"), body)
    listed = docs.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("place", one.alias("text")))).alias("all"))
    return listed.select("unit", F.size("all").alias("n_docs"), F.array_join(F.transform("all", lambda d: d["text"]), "\n\n").alias("packet"))


def reduced(facts: DataFrame, keys: list[str], order: list[str], value: str, most: int = 60_000) -> DataFrame:
    """(keys, n, reduced): what the map step found in each document, null where it failed, as one list in order, cut after `most` characters: the
    input of the reduce step of a card. A card's documents are few; cards are many and spread by key."""
    listed = facts.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, value))).alias("all"))
    joined = F.concat(F.lit("["), F.array_join(F.transform("all", lambda x: x[value]), ", "), F.lit("]"))
    return listed.select(*keys, F.size("all").alias("n"), F.substring(joined, 1, most).alias("reduced"))
