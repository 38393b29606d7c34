"""Forecast units on disk: cards (TOML), corpus indexes and reference scales, and the evidence that they were not changed."""

from __future__ import annotations

import glob
import os
import tomllib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import META_BYTES, Refused, regular_file

CARD = "unit_id string, asof date, assets array<string>, horizons array<int>, target_type string, frequency string, category string, weights array<double>, tail_levels array<double>, joint string, tail_metric string"
#: Where a unit's card may lie, first one first.
CARD_PLACES = ("card.toml", "task.toml", "card/card.toml")
INDEX = "documents array<struct<doc_id:string,timestamp:string,doc_type:string,file:string,path:string,source:string>>"
SCALE_KEYS = ("marginal", "joint", "tail", "method", "seed", "generated")


def load_card(unit_dir: str) -> tuple:
    """One card as a row of CARD; text and lists are checked, absent parts get their defaults."""
    path = next((p for p in (os.path.join(unit_dir, x) for x in CARD_PLACES) if os.path.exists(p)), None)
    if path is None:
        raise Refused(f"{unit_dir}: no card")
    regular_file(path, META_BYTES)
    with open(path, "rb") as f:
        card = tomllib.load(f)
    targets, params = card["targets"], card.get("scoring", {}).get("params", {})
    assets, horizons = list(targets["asset_ids"]), [int(h) for h in targets["horizons"]]
    if not assets or not horizons or len(set(assets)) < len(assets) or len(set(horizons)) < len(horizons) or min(horizons) < 1:
        raise Refused(f"{path}: bad axes")
    cutoff = card.get("provenance", {}).get("data_cutoff")
    if isinstance(cutoff, str):
        import datetime

        cutoff = datetime.date.fromisoformat(cutoff[:10])
    return (
        card["task"]["id"], cutoff, assets, horizons, targets.get("target_type", "level"), targets.get("target_frequency", "daily"), card.get("metadata", {}).get("category"),
        [float(x) for x in params.get("weights", (0.5, 0.3, 0.2))], [float(x) for x in params.get("tail_levels", (0.01, 0.05, 0.95, 0.99))], params.get("joint", "variogram"), params.get("tail_metric", "pinball"),
    )


def scan_cards(spark: SparkSession, root: str) -> DataFrame:
    """A row for each unit folder of root that holds a card: a folder listing and files of a few KB, read by the driver."""
    rows = [load_card(p) for p in sorted(glob.glob(os.path.join(root, "*/"))) if any(os.path.exists(os.path.join(p, x)) for x in CARD_PLACES)]
    return spark.createDataFrame(rows, CARD)


def scan_corpus(spark: SparkSession, pattern: str, max_bytes: int = META_BYTES) -> DataFrame:
    """(unit_dir, doc_id, timestamp, doc_type, file, text) of all documents that the corpus indexes of pattern list and that exist."""
    found = spark.read.format("binaryFile").load(pattern).filter(F.col("length") <= max_bytes)
    index = found.select(F.regexp_replace("path", "/[^/]*$", "").alias("unit_dir"), F.explode(F.from_json(F.col("content").cast("string"), INDEX)["documents"]).alias("d"))
    listed = index.select("unit_dir", "d.doc_id", F.to_date(F.substring("d.timestamp", 1, 10)).alias("timestamp"), "d.doc_type", F.coalesce("d.file", "d.path").alias("file"))
    texts = spark.read.text(pattern.rsplit("/", 1)[0], wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("at"), F.col("value").alias("text"))
    return listed.withColumn("at", F.concat_ws("/", "unit_dir", "file")).join(texts, "at").drop("at")


def scan_results(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """Result tables as CSV with a header or as JSON lines, under a schema; a malformed row is an error."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    return reader.option("header", True).csv(path) if kind == "csv" else reader.json(path)


def digests(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.sha2("content", 256).alias("sha256"))


def commitment(pairs: DataFrame, handle: str = "handle", digest: str = "sha256") -> str:
    """One SHA-256 over all handles with their digests: of the digests of 256 buckets, each over its lines in the order of handles. Only the
    last one comes to the driver."""
    line = F.concat(F.col(handle), F.lit("="), F.coalesce(F.col(digest), F.lit("")), F.lit("\n"))
    buckets = pairs.select(F.substring(F.sha2(F.col(handle).cast("binary"), 256), 1, 2).alias("b"), F.struct(F.col(handle).alias("h"), line.alias("line")).alias("x")).groupBy("b").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    each = buckets.select("b", F.sha2(F.array_join(F.transform("xs", lambda x: x["line"]), "").cast("binary"), 256).alias("d"))
    whole = each.agg(F.array_sort(F.collect_list(F.struct("b", "d"))).alias("all"))
    return whole.select(F.sha2(F.array_join(F.transform("all", lambda x: F.concat(x["b"], x["d"])), "").cast("binary"), 256).alias("d")).first().d


def verified_scales(spark: SparkSession, pattern: str, roster: DataFrame, expected: str) -> DataFrame:
    """(handle, marginal, joint, tail): the scale of every unit of the roster, each file read once. The folders must be the roster, the
    digests must give the expected commitment, and every scale must be finite and above 0; else refused. handle: the folder's name."""
    files = spark.read.format("binaryFile").load(pattern)
    read = files.select(F.element_at(F.split("path", "/"), -2).alias("handle"), F.sha2("content", 256).alias("sha256"), F.from_json(F.col("content").cast("string"), T.MapType(T.StringType(), T.StringType())).alias("m"))
    both = roster.select("handle", F.lit(True).alias("own")).join(read, "handle", "full_outer")
    rows = both.select("handle", "own", "sha256", F.array_except(F.map_keys("m"), F.array(*map(F.lit, SCALE_KEYS))).alias("odd"), *[F.try_element_at("m", F.lit(k)).cast("double").alias(k) for k in SCALE_KEYS[:3]])
    bad = rows.filter(F.col("own").isNull() | F.col("sha256").isNull() | (F.size("odd") > 0) | ~F.coalesce((F.col("marginal") > 0) & (F.col("tail") > 0) & F.coalesce(F.col("joint") > 0, F.lit(True)), F.lit(False)))
    faults = bad.count()
    found = commitment(rows.filter("sha256 is not null"))
    if faults or found != expected:
        raise Refused(f"{faults} faulty scales; commitment {found}")
    return rows.select("handle", *SCALE_KEYS[:3])


def stage(spark: SparkSession, pattern: str, folder: str) -> DataFrame:
    """(path, sha256, copy): the files of pattern copied under folder, each in a folder of its digest, and set to be read only. Copying is the file
    system's own; a staged copy with another digest than its source's is an error."""
    context = spark.sparkContext
    fs, conf = context._jvm.org.apache.hadoop.fs, context._jsc.hadoopConfiguration()
    rows = [(r.path, r.sha256, f"{folder}/{r.sha256}/{r.path.rsplit('/', 1)[-1]}") for r in digests(spark, pattern).toLocalIterator()]
    for path, _, copy in rows:
        a, b = fs.Path(path), fs.Path(copy)
        fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf)
        b.getFileSystem(conf).setPermission(b, fs.permission.FsPermission("444"))
    staged = spark.createDataFrame(rows, "path string, sha256 string, copy string")
    if changed(staged.select("copy", "sha256"), digests(spark, f"{folder}/*/*").select(F.col("path").alias("copy"), "sha256")):
        raise Refused(f"{folder}: a staged copy differs from its source")
    return staged


def changed(before: DataFrame, after: DataFrame) -> int:
    """How many rows (name, sha256) only one side has; names without their scheme."""
    plain = lambda df: df.select(F.regexp_replace(df.columns[0], "^file:/+", "/").alias("name"), "sha256")
    a, b = plain(before), plain(after)
    return a.exceptAll(b).count() + b.exceptAll(a).count()


@dataclass(frozen=True)
class Evidence:
    """What an evidence-chain run found; such a run is never ranked, whatever it found."""

    files: int
    source_changed: int
    copies_changed: int
    rows_differ: int
    rankable: bool = False

    @property
    def sound(self) -> bool:
        return not (self.source_changed or self.copies_changed or self.rows_differ)


def with_evidence(spark: SparkSession, pattern: str, folder: str, score: Callable[[str], DataFrame]) -> tuple[DataFrame, Evidence]:
    """The rows that score() gives of read-only copies, scored twice, with what was found: files changed at the source or among the copies while
    it ran, and rows that the second run gave differently."""
    before = stage(spark, pattern, folder)
    copies = f"{folder}/*/*"
    first = score(copies).persist()
    n_first = first.count()
    second = score(copies)
    differ = first.exceptAll(second).count() + abs(second.count() - n_first)
    after = digests(spark, pattern)
    return first, Evidence(before.count(), changed(before.select("path", "sha256"), after), changed(before.select("copy", "sha256"), digests(spark, copies)), differ)
