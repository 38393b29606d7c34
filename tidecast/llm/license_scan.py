"""License scan by diagonal voting, in DataFrame operations only.

Every text's rolling word pairs are hashed and joined to the places of those pairs in the license templates. A hit at text
word p and template word q votes for the diagonal p - q; votes are summed by (text, template, diagonal) as a bit mask of the
template pairs seen, diagonals at most ``GAP`` apart are merged (words put in or left out), and a merged span is verified by
the words themselves (hits compare words, not hashes alone), by the share of the template it covers and by its extent.

The template side of the join is a constant of this module, so its broadcast is bounded and its keys filter a text's pairs
before these become rows. Each text ends with one sentinel that carries the number of words, so one scan serves all columns,
and only hits are shuffled, as a few numbers and two words.

Cases: a null or empty text has no words and no license; a very long text is one row until its hits are found; rows that agree
in id and text are told apart by their number, each gives a row; null ids are kept; extra columns, such as one named like a
result, are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few_files, read, rest

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases of public licenses. The first four are the base phrases; no template has more than 64 words.
BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
MORE = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("as published by the free software foundation either version 3 of the license or at your option any later version", "gpl-3.0-or-later"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("creative commons attribution 4 0 international license", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("subject to the terms of the eclipse public license", "epl"),
]
TEMPLATES = [*BASE, *MORE]
SENTINEL = -6148914691236517206
GAP = 3
COVER = 0.8


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased. lower() also changes other letters, which only matters where it makes an ASCII letter of one."""
    odd = F.contains(text, F.lit("K")) | F.contains(text, F.lit("İ"))
    return F.when(odd, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def _pairs() -> list[tuple]:
    """(t, q, first word, second word, words of the template, label, base) of each word pair of each template."""
    return [(t, q, *phrase.split()[q : q + 2], len(phrase.split()), label, t < len(BASE)) for t, (phrase, label) in enumerate(TEMPLATES) for q in range(len(phrase.split()) - 1)]


def _values() -> str:
    return ", ".join(f"({t}, {q}, '{a}', '{b}', {n}, '{label}', {str(base).lower()})" for t, q, a, b, n, label, base in _pairs())


def _places(spark) -> DataFrame:
    """A relation of literals, so no task and no Python stands behind it."""
    places = spark.sql(f"SELECT *, xxhash64(w0, w1) AS hash FROM VALUES {_values()} AS p(t, q, w0, w1, t_words, label, base)")
    end = spark.sql(f"SELECT -1 AS t, 0 AS q, 0 AS t_words, {SENTINEL}L AS hash")
    return places.unionByName(end, allowMissingColumns=True)


def scan(docs: DataFrame, id_column: str = "doc_id", text: str = "text", cover: float = COVER, gap: int = GAP) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row of docs."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = docs.select(
        F.col(id_column).alias("id"), F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(1), body).alias("k2"),
        F.array_remove(F.split(lower_ascii(body), BETWEEN, -1), "").alias("words"),  # regexp_extract_all() copies the text for each match
    )
    # the join's keys are constants, so the pairs that it would drop go before they are rows
    some = F.array(*[F.xxhash64(F.lit(a), F.lit(b)) for a, b in sorted({x[2:4] for x in _pairs()})])
    known = docs.sparkSession.range(1).select(F.explode(some)).collect()  # as many as the templates have pairs
    pair = lambda a, i: F.struct(i.alias("p"), F.xxhash64(a, F.get("words", i + 1)).alias("hash"))
    rolled = words.select("id", "k1", "k2", "words", F.filter(F.transform(F.slice("words", F.lit(1), F.greatest(F.size("words") - 1, F.lit(0))), pair), lambda x: x["hash"].isin([r[0] for r in known])).alias("pairs"))
    full = F.transform("pairs", lambda x: F.struct(x["p"].alias("p"), x["hash"].alias("hash"), F.get("words", x["p"]).alias("a"), F.get("words", x["p"] + 1).alias("b")))
    end = F.array(F.struct(F.size("words").alias("p"), F.lit(SENTINEL).alias("hash"), F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b")))
    each = rolled.select("id", "k1", "k2", F.concat(full, end).alias("pairs")).select("id", "k1", "k2", F.inline_outer("pairs"))
    hits = each.join(F.broadcast(_places(docs.sparkSession)), "hash").filter((F.col("t") < 0) | ((F.col("a") == F.col("w0")) & (F.col("b") == F.col("w1"))))
    key = ["id", "k1", "k2"]
    votes = hits.groupBy(*key, "t", "t_words", "label", "base", (F.col("p") - F.col("q")).alias("diagonal")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("q"))).alias("seen"), F.count("*").alias("n"), F.min("p").alias("low"), F.max("p").alias("high")
    )
    order = Window.partitionBy(*key).orderBy("t", "diagonal")
    fresh = (F.col("t") != F.lag("t", 1, -2).over(order)) | (F.col("diagonal") - F.lag("diagonal", 1, 0).over(order) > gap)
    spans = votes.withColumn("fresh", fresh.cast("int")).withColumn("span", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.col("t_words") - 1
    whole = F.col("base") & (F.bit_count("seen") == size)
    merged = spans.groupBy(*key, "span", "t", "t_words", "label").agg(
        F.bit_or("seen").alias("seen"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.count(F.when(whole, 1)).alias("n_base"), F.min(F.when(whole, F.col("diagonal"))).alias("first_word"), F.max(F.when(whole, F.col("diagonal"))).alias("last_word"),
        F.max(F.when(F.col("t") < 0, F.col("diagonal"))).alias("n_words"), F.max(F.when(F.col("t") < 0, F.col("n"))).alias("copies"),
    )
    share = F.bit_count("seen") / size
    verified = (F.col("n_base") > 0) | ((share >= cover) & (F.col("high") - F.col("low") + 2 <= 2 * F.col("t_words")))
    named = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    found = merged.groupBy(*key).agg(
        F.max("n_words").cast("long").alias("n_words"), F.max("copies").alias("copies"), F.sum("n_base").alias("n_base"),
        F.min("first_word").cast("long").alias("first_word"), F.max("last_word").cast("long").alias("last_word"),
        named(F.col("n_base") > 0).alias("base_labels"), named(verified & (F.col("t") >= 0)).alias("labels"),
        F.coalesce(F.max(F.when(F.col("t") >= 0, share)), F.lit(0.0)).alias("score"),
    )
    one_each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return one_each.select(F.col("id").alias(id_column), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    rest(spark)
    return few_files(scan(read(spark, sf_dir, "documents")))


OP1_SQL = rf"""
WITH places(t, q, w0, w1, t_words, label, base) AS (VALUES {_values()}),
docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents
), words AS (
  SELECT doc_id, unnest(w) AS a, unnest(w[2:]) AS b, unnest(range(len(w))) AS p FROM docs
), votes AS (
  SELECT doc_id, t, t_words, label, base, p - q AS diagonal, count(DISTINCT q) AS c, list(DISTINCT q) AS qs, min(p) AS low, max(p) AS high
  FROM words JOIN places ON a = w0 AND b = w1 GROUP BY ALL
), fresh AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, t ORDER BY diagonal) <= {GAP} THEN 0 ELSE 1 END AS f FROM votes
), spans AS (
  SELECT *, sum(f) OVER (PARTITION BY doc_id, t ORDER BY diagonal) AS span FROM fresh
), merged AS (
  SELECT doc_id, t, span, t_words, label, len(list_distinct(flatten(list(qs)))) / (t_words - 1) AS share, min(low) AS low, max(high) AS high,
         count(*) FILTER (WHERE base AND c = t_words - 1) AS n_base,
         min(diagonal) FILTER (WHERE base AND c = t_words - 1) AS first_word, max(diagonal) FILTER (WHERE base AND c = t_words - 1) AS last_word
  FROM spans GROUP BY doc_id, t, span, t_words, label
), found AS (
  SELECT doc_id, sum(n_base)::BIGINT AS n_base, min(first_word) AS first_word, max(last_word) AS last_word, max(share) AS score,
         coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE n_base > 0), '') AS base_labels,
         coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE n_base > 0 OR (share >= {COVER} AND high - low + 2 <= 2 * t_words)), '') AS labels
  FROM merged GROUP BY doc_id
)
SELECT docs.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM docs LEFT JOIN found ON docs.doc_id = found.doc_id
"""
