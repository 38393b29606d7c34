"""Secret scan over an incremental blob ledger, in DataFrame operations only.

Every version of every path is content-addressed: its blob is the SHA-256 of its text. The ledger is a Parquet folder of
(blob, rule_version, spans). A scan looks only at (blob, rule version) pairs that the ledger lacks, appends their findings and
joins findings back to all paths, so copies, old versions and repeated runs cost a hash each. A large group of copies is one
blob: it is reduced to one row before the shuffle, and only the narrow join back to its paths sees all of them (two plain
equi-join sides, whose large partitions Spark may split).

Places of matches: split() at a pattern gives what lies between its matches, regexp_extract_all() the matches; running sums of
their lengths are the spans, in code points.

Cases: a null text counts as empty and has no spans; repeated rows give a row each; null ids are kept; extra columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few_files, read, rest, scratch_dir


@dataclass(frozen=True)
class SecretRule:
    """kind; pattern, whose group `value` must have min_value code points (leftmost matches that fail are dropped)."""

    kind: str
    pattern: str
    value: int = 0
    min_value: int = 0


# The patterns. The first three are the base kinds, in the order of their spans.
BASE_RULES = (
    SecretRule("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 16),
    SecretRule("hex", r"[0-9a-f]+", 0, 32),
)
MORE_RULES = (
    SecretRule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    SecretRule("hosting", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36}"),
    SecretRule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    SecretRule("maps", r"AIza[A-Za-z0-9_-]{35}"),
)
RULES = (*BASE_RULES, *MORE_RULES)
#: Same matches as the hex rule's runs of 32 or more, without stopping at each short run.
_LONG_HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"

SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"


def rule_version(rules=RULES) -> str:
    return hashlib.sha256(json.dumps([[r.kind, r.pattern, r.value, r.min_value] for r in rules]).encode()).hexdigest()[:16]


def _spans(text: Column, rank: int, rule: SecretRule) -> Column:
    pattern = F.lit(_LONG_HEX if rule == BASE_RULES[2] else rule.pattern)
    gaps = F.transform(F.split(text, _LONG_HEX if rule == BASE_RULES[2] else rule.pattern, -1), lambda x: F.length(x))
    sizes = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda x: F.length(x))
    values = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.value)), lambda x: F.length(x)) if rule.value else sizes
    state = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("found"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["size"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["value"] >= rule.min_value, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    matches = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(sizes)).alias("gap"), sizes.alias("size"), values.alias("value"))
    found = F.aggregate(matches, state, step, lambda acc: acc["found"])
    return F.when(F.rlike(text, pattern), found).otherwise(F.array().cast(SPANS))


def scan_text(text: Column, rules=RULES) -> Column:
    """Spans of all rules by start, then rule order; code points, end exclusive. A column to be computed once, from one text column."""
    return F.array_sort(F.concat(*[_spans(text, i, r) for i, r in enumerate(rules)]))


def _ledger(spark, path: str) -> DataFrame:
    schema = f"blob binary, rule_version string, spans {SPANS}"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # the first run: no folder yet
        return spark.createDataFrame([], schema)


def scan_versions(versions: DataFrame, ledger: str, text: str = "text", rules=RULES) -> DataFrame:
    """versions with spans added (a column of that name is replaced); unseen pairs of blob and rule version are scanned and put into the ledger folder."""
    spark, version = versions.sparkSession, rule_version(rules)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    blob = F.unhex(F.sha2(body.cast("binary"), 256))
    seen = _ledger(spark, ledger).filter(F.col("rule_version") == version)
    blobs = versions.select(blob.alias("blob"), body.alias("body")).groupBy("blob").agg(F.first("body").alias("body"))
    unseen = blobs.join(seen.select("blob"), "blob", "left_anti")
    unseen.select("blob", F.lit(version).alias("rule_version"), scan_text(F.col("body"), rules).alias("spans")).write.mode("append").parquet(ledger)
    known = _ledger(spark, ledger).filter((F.col("rule_version") == version) & (F.size("spans") > 0)).dropDuplicates(["blob"]).select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans"))
    paths = versions.drop("spans").withColumn("__blob", blob)
    return paths.join(known, "__blob", "left").withColumn("spans", F.coalesce("__spans", F.array().cast(SPANS))).drop("__blob", "__spans")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    """A fresh ledger: every blob of the table is unseen."""
    rest(spark)
    ledger = f"{scratch_dir(spark)}/tidecast/ledger-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_versions(docs, ledger).select("doc_id", "spans")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))
    return few_files(found.select("doc_id", *[of(r.kind) for r in BASE_RULES], F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans")))


def _sql_kind(rank: int, rule: SecretRule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, m, v, g, i,
         sum(g + m) OVER (PARTITION BY doc_id ORDER BY i) - m AS s
  FROM (SELECT doc_id, unnest(range(len(ms))) AS i, unnest(list_transform(ms, lambda x: length(x))) AS m,
               unnest(list_transform(vs, lambda x: length(x))) AS v, unnest(list_transform(gs[:len(ms)], lambda x: length(x))) AS g
        FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, regexp_extract_all(t, '{pattern}', {rule.value}) AS vs,
                     string_split_regex(t, '{pattern}') AS gs FROM docs))
  WHERE true QUALIFY v >= {rule.min_value}"""


OP7_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({' UNION ALL '.join(_sql_kind(i, r) for i, r in enumerate(RULES))}
), named AS (SELECT doc_id, kind, rank, s, kind || ':' || s::BIGINT || ':' || (s + m)::BIGINT AS x FROM found
), by_doc AS (
  SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS a, count(*) FILTER (WHERE rank = 1) AS b, count(*) FILTER (WHERE rank = 2) AS c,
         string_agg(x, ',' ORDER BY s, rank) FILTER (WHERE rank < 3) AS base, string_agg(x, ',' ORDER BY s, rank) AS spans
  FROM named GROUP BY doc_id
)
SELECT docs.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN by_doc ON docs.doc_id = by_doc.doc_id
"""
