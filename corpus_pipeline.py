"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination and sampled piece encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the columns of
documents, with the same names, order and types. Between stages the rows are written as Parquet to the shared folder, so a lost
executor costs its own tasks only.

All stages: rows with a null id stay rows like others; very long texts are taken whole; extra columns are kept as they are, also
where they bear the name of a column that an operator adds (but the last stage has columns of its own); an empty table gives an
empty table of the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm import decontamination, near_dedup, piece_sampling, quality_rules
from tidecast.llm import line_dedup as lines
from tidecast.llm.common import discard, read, rest, stored


def _apart(docs: DataFrame, added: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """stage(docs) with the columns of docs; those that bear the name of one that the stage adds go by another meanwhile."""
    rest(docs.sparkSession)
    away = {c: f"__own_{c}" for c in docs.columns if c in added}
    out = stage(docs.withColumnsRenamed(away))
    return out.drop(*away).withColumnsRenamed({b: a for a, b in away.items()}).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go.

    Null, empty and blank texts have no words and go, as too short. Copies and repeated rows share a verdict: all stay or all go.
    A text just at a rule's bound stays, as each rule rejects beyond its bound."""
    return _apart(docs, ("kept",), lambda d: quality_rules.judge(d).filter("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more hold go everywhere; n_chars, where there is such a column, follows the text that is left.

    Null texts stay null, empty ones empty; an empty line is never dropped. A repeated row counts as a document of its own, and ten
    documents are enough. A text whose lines all go is left empty, and stays a row."""

    def stage(d: DataFrame) -> DataFrame:
        kept = lines.drop_lines(d)
        if "n_chars" not in d.columns:
            return kept
        kind = d.schema["n_chars"].dataType
        return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))

    return _apart(docs, ("n_lines", "n_dropped"), stage)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id stays; of equal ids the text with the least hash.

    A null text counts as an empty one; all empty texts are one class, of which one row stays, and texts of the same blanks are
    copies. Of a repeated row one stays. A class without any id keeps a row of each of its texts."""
    return _apart(docs, ("__copy", "__key"), near_dedup.keep_one)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with up to 15 % of its words edited, go.

    Null and empty texts hold none and stay; copies and repeated rows go together."""
    rest(spark)
    return decontamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, pieces, n_pieces, lossless): sampled piece ids of each text, and whether decoding gives the text back.

    A null text has null pieces, n_pieces null, and is lossless; an empty one has the piece of the space before it. Repeated rows, and
    copies under one id, have equal pieces; copies under other ids are sampled by themselves. Null ids share one seed. A column
    that documents lack is null."""
    rest(spark)
    docs = docs.select(*[F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("doc_id", "text", "lang", "source")])
    vocabulary = piece_sampling.Vocabulary.load()
    decoded = piece_sampling.decode(piece_sampling.encode(docs, vocabulary), vocabulary)
    return decoded.select("doc_id", "lang", "source", "pieces", F.when(F.col("pieces").isNotNull(), F.size("pieces")).alias("n_pieces"), F.equal_null("text", "decoded").alias("lossless"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece encoding", encode),
]

ORACLE_SQL = None  # near-duplicate classes and sampled segmentations have no SQL form; tests/llm holds brute-force versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)  # what is read now is written
    return STAGES[-1][1](spark, docs, sf_dir)
