"""Files at the border: footers, exact schemas, bounded JSON and text, and the sinks for draws and results."""

from __future__ import annotations

import json
import os
import stat

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Ceilings of what is read from an unknown party.
META_BYTES, TEXT_BYTES, PARQUET_BYTES = 256 * 1024, 1024 * 1024, 64 * 1024 * 1024
MAX_ROWS, MAX_COLUMNS, MAX_ROW_GROUPS = 5_000_000, 8, 64


class Refused(ValueError):
    """A file that breaks a ceiling or a rule."""


def inspect_parquet(spark: SparkSession, path: str, max_rows: int = MAX_ROWS, max_columns: int = MAX_COLUMNS, max_row_groups: int = MAX_ROW_GROUPS, max_bytes: int = PARQUET_BYTES) -> DataFrame:
    """(file, n_rows, n_columns, row_groups, uncompressed, fault) of each Parquet file of a path: nothing but footers is read, by the driver and from
    any file system of the cluster; fault names the first ceiling that a file breaks."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    rows = []
    for file in sorted(spark.read.parquet(path).inputFiles()):
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(file), conf))
        try:
            blocks, schema = reader.getFooter().getBlocks(), reader.getFooter().getFileMetaData().getSchema()
            facts = (sum(b.getRowCount() for b in blocks), schema.getFieldCount(), len(blocks), sum(b.getTotalByteSize() for b in blocks))
        finally:
            reader.close()
        limits = (("rows", max_rows), ("columns", max_columns), ("row_groups", max_row_groups), ("bytes", max_bytes))
        rows.append((file, *facts, next((name for (name, most), n in zip(limits, facts, strict=True) if n > most), None)))
    return spark.createDataFrame(rows, "file string, n_rows long, n_columns int, row_groups int, uncompressed long, fault string")


def footer(path: str, max_rows: int = MAX_ROWS, max_columns: int = MAX_COLUMNS, max_row_groups: int = MAX_ROW_GROUPS) -> dict:
    """Facts of one local file's footer; refused beyond the ceilings."""
    import pyarrow.parquet as pq

    regular_file(path, PARQUET_BYTES)
    m = pq.ParquetFile(path).metadata
    facts = {"rows": m.num_rows, "columns": m.num_columns, "row_groups": m.num_row_groups, "bytes": sum(m.row_group(i).total_byte_size for i in range(m.num_row_groups))}
    if m.num_rows > max_rows or m.num_columns > max_columns or m.num_row_groups > max_row_groups:
        raise Refused(f"{path}: {facts}")
    return facts


def read_exact(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """df if it has just these columns, pruned to keep; else refused."""
    if set(df.columns) != set(columns) or len(df.columns) != len(columns):
        raise Refused(f"missing {sorted(set(columns) - set(df.columns))}, extra {sorted(set(df.columns) - set(columns))}")
    return df.select(*(keep or columns))


def regular_file(path: str, max_bytes: int) -> os.stat_result:
    """The file's facts; links, pipes, hard links and larger files are refused."""
    s = os.lstat(path)
    if not stat.S_ISREG(s.st_mode) or s.st_nlink > 1 or s.st_size > max_bytes:
        raise Refused(path)
    return s


def read_json(path: str, max_bytes: int = META_BYTES) -> dict:
    regular_file(path, max_bytes)
    with open(path, "rb") as f:
        found = json.loads(f.read(max_bytes).decode())
    if not isinstance(found, dict):
        raise Refused(f"{path}: not an object")
    return found


def has_text(text: Column) -> Column:
    return F.length(F.trim(F.coalesce(text, F.lit("")))) > 0


def write_results(rows: DataFrame, path: str) -> None:
    """Scores as JSON lines in one folder, and the failures in another, which exists even when there are none."""
    rows.filter("score is not null").write.mode("overwrite").json(f"{path}/scores")
    rows.filter("score is null").write.mode("overwrite").json(f"{path}/details")
