"""What is written of forecasts and results: draws with their sidecar, ledger and rationale, dumps, and caches of results."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Quantiles of the ledger, names of the sidecar's representation and rationale, and the modes of what others read.
LEDGER_LEVELS = (0.05, 0.5, 0.95)
REPRESENTATION, RATIONALE = "samples", "forecast_rationale.md"
FILE_MODE, FOLDER_MODE = 0o644, 0o755


def ledger(draws: DataFrame) -> DataFrame:
    """(unit_id, asset, horizon, low, mid, high) of draws (unit_id, draw, asset, horizon, value)."""
    q = F.expr(f"percentile(value, array({', '.join(f'{x}D' for x in LEDGER_LEVELS)}))")
    return draws.groupBy("unit_id", "asset", "horizon").agg(q.alias("q")).select("unit_id", "asset", "horizon", *[F.col("q")[i].alias(n) for i, n in enumerate(("low", "mid", "high"))])


def rationales(draws: DataFrame, cards: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """(unit_id, text): Markdown with the method, a row of the ledger for each cell, and what a note (unit_id, note) says. cards: (unit_id, as_of, target)."""
    number = lambda c: F.format_string("%.6g", c)
    line = F.concat_ws(" | ", F.concat(F.lit("| "), "asset"), F.col("horizon").cast("string"), number("low"), number("mid"), F.concat(number("high"), F.lit(" |")))
    rows = ledger(draws).groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("asset", "horizon", line.alias("line")))).alias("rows"))
    methods = draws.groupBy("unit_id").agg(F.array_join(F.array_sort(F.collect_set("method")), ", ").alias("method")) if "method" in draws.columns else None
    out = cards.select("unit_id", "as_of").join(rows, "unit_id", "left")
    out = out.join(methods, "unit_id", "left") if methods is not None else out.withColumn("method", F.lit(None).cast("string"))
    out = out.join(notes, "unit_id", "left") if notes is not None else out.withColumn("note", F.lit(None).cast("string"))
    table = F.coalesce(F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit(""))
    parts = ["# Forecast ", F.col("unit_id"), "\n\nAs of ", F.col("as_of").cast("string"), ". Method: ", F.coalesce("method", F.lit("none")), ". Only rows dated at or before the as-of date were used.\n\n", "| asset | horizon | 5 % | median | 95 % |\n|---|---|---|---|---|\n", table, "\n\n", F.coalesce("note", F.lit("No text was used.")), "\n"]
    return out.select("unit_id", F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("text"))


def sidecars(draws: DataFrame, cards: DataFrame) -> DataFrame:
    """(unit_id, text): the JSON that tells what a unit's draws are."""
    of = draws.groupBy("unit_id").agg(F.array_sort(F.collect_set("asset")).alias("asset_ids"), F.array_sort(F.collect_set("horizon")).alias("horizons"), F.countDistinct("draw").alias("n_draws"))
    meta = F.struct("unit_id", F.col("as_of").cast("string").alias("asof"), F.lit(REPRESENTATION).alias("representation"), "asset_ids", "horizons", "n_draws", "target", F.struct(F.lit(RATIONALE).alias("file")).alias("rationale"))
    return cards.join(of, "unit_id").select("unit_id", F.to_json(meta).alias("text"))


def write_forecasts(draws: DataFrame, cards: DataFrame, path: str, notes: DataFrame | None = None) -> None:
    """Three tables beside each other, each with a folder a unit: draws as Parquet, meta (one JSON line) and rationale (Markdown). Existing ones
    are an error. On a local file system all may read them afterwards."""
    draws.select("unit_id", F.col("draw").cast("int"), "asset", F.col("horizon").cast("int"), F.col("value").cast("double")).repartition("unit_id").write.mode("errorifexists").partitionBy("unit_id").parquet(f"{path}/draws")
    sidecars(draws, cards).write.mode("errorifexists").partitionBy("unit_id").text(f"{path}/meta")
    rationales(draws, cards, notes).write.mode("errorifexists").partitionBy("unit_id").option("lineSep", "\n").text(f"{path}/rationale")
    readable(path)


def readable(path: str) -> None:
    """Opens a local folder to all readers; other file systems have rights of their own."""
    local = path.removeprefix("file://")
    for folder, _, names in os.walk(local) if os.path.isdir(local) else ():
        os.chmod(folder, FOLDER_MODE)
        for name in names:
            os.chmod(os.path.join(folder, name), FILE_MODE)


def write_dumps(df: DataFrame, path: str, kinds: tuple[str, ...] = ("parquet", "csv", "json")) -> None:
    """The same rows in each format, in a folder of its name; arrays, maps and structs go to CSV as JSON text."""
    for kind in kinds:
        flat = df.select(*[F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name) for f in df.schema]) if kind == "csv" else df
        writer = flat.write.mode("overwrite")
        getattr(writer.option("header", True) if kind == "csv" else writer, kind)(f"{path}/{kind}")


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at path if a finished write left one; else that of build(), written there."""
    context = spark.sparkContext
    done = context._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(context._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
