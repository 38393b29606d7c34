"""Line dedup with two Bloom filters for once-seen and twice-seen line hashes.

1. Every task notes the keys of its documents' lines in a once-seen and a twice-seen filter; merged, they leave one bounded
   twice-seen filter (``common.TwiceFilter``).
2. Only lines that this filter suspects are shuffled, as 128-bit hashes, one per document and key: exact counts of
   documents, and the first occurrence (least id, then least line), come from a plain aggregation with map-side sums, so no key
   makes a task hot.
3. The keys to drop go to all tasks as two sorted arrays when their exact number is at most ``broadcast_keys`` (16 bytes a key,
   32 bytes with first occurrences); beyond, they are joined to the documents' lines, both sides being plain, and only the
   documents that lose a line meet their list of lines by a shuffle.

Cases: a null or empty text is one empty line; an empty key is never dropped; very long texts are taken whole; a repeated row
counts as another document, and rows of one id share a first occurrence; null ids are kept (an occurrence with an id is before one
without); other columns stay as they are, but one named n_lines or n_dropped is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, SPACE_BYTES, U64, TwiceFilter, as_bytes, filter_bits, in_arrow, line_count, signed, stored

BROADCAST_KEYS = 2_000_000  # 32 MB, 64 MB with first occurrences


def line_keys(text: bytes) -> list[bytes]:
    """Each line stripped of ASCII white space at both ends, with A-Z lower-cased."""
    return [x.strip(SPACE_BYTES) for x in text.translate(LOWER).split(b"\n")]


def _digests(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), U64).reshape(-1, 2)


def _distinct(text: bytes, min_chars: int) -> np.ndarray:
    keys = {k for k in line_keys(text) if k and (min_chars <= 1 or len(k.decode("utf-8", "replace")) >= min_chars)}
    return _digests(list(keys))


def repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text", id_column: str | None = None) -> DataFrame:
    """(h1, h2, docs): 128-bit hashes of the keys of min_chars code points that at least min_docs documents hold (min_docs >= 2).

    With an id column also first, the least (id, line number from 0) that holds the key."""
    rows = docs.select(F.col(text).cast("string").alias("text"), *([F.col(id_column).alias("id")] if id_column else []))
    seen = TwiceFilter.build(rows.select("text"), lambda x: _distinct(x, min_chars)[:, 0], filter_bits(line_count(rows)))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, which, lines = [], [], []
            for k, x in enumerate(as_bytes(batch.column(0))):
                if id_column:
                    at: dict[bytes, int] = {}
                    for i, key in enumerate(line_keys(x)):
                        if key and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars):
                            at.setdefault(key, i)
                    h = _digests(list(at))
                else:
                    h = _distinct(x, min_chars)
                held = seen(h[:, 0])
                found.append(h[held])
                if id_column:
                    which.append(np.full(int(held.sum()), k))
                    lines.append(np.array(list(at.values()), np.int32)[held])
            if found:
                h = np.concatenate(found)
                more = [batch.column(1).take(pa.array(np.concatenate(which).astype(np.int64))), pa.array(np.concatenate(lines).astype(np.int32))] if id_column else []
                yield pa.RecordBatch.from_arrays([signed(h[:, i].copy()) for i in (0, 1)] + more, schema.names)

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("h1", "h2")] + ([T.StructField("id", docs.schema[id_column].dataType), T.StructField("line", T.IntegerType())] if id_column else []))
    first = [F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "line")).alias("first")] if id_column else []
    return in_arrow(rows, suspects, schema).groupBy("h1", "h2").agg(F.count("*").alias("docs"), *first).filter(F.col("docs") >= min_docs)


class _Keys:
    """Sorted 128-bit keys."""

    def __init__(self, h: np.ndarray):
        order = np.lexsort((h[:, 1], h[:, 0]))
        self.h1, self.h2 = h[order, 0], h[order, 1]

    def hold(self, h: np.ndarray) -> np.ndarray:
        """Which of these are held."""
        at, out, open_ = np.searchsorted(self.h1, h[:, 0]), np.zeros(len(h), bool), np.arange(len(h))
        while len(open_):  # keys that share their first half follow each other
            open_ = open_[at[open_] < len(self.h1)]
            open_ = open_[self.h1[at[open_]] == h[open_, 0]]
            hit = self.h2[at[open_]] == h[open_, 1]
            out[open_[hit]] = True
            open_ = open_[~hit]
            at[open_] += 1
        return out


def drop_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text", broadcast_keys: int = BROADCAST_KEYS, keep_first: str | None = None) -> DataFrame:
    """docs with all lines gone whose key is in min_docs documents or more; adds n_lines and n_dropped after the columns of docs
    (a column of docs with such a name is replaced). keep_first: an id column; the first occurrence of each such key then stays."""
    docs = docs.drop(*[c for c in ("n_lines", "n_dropped") if c != text])
    drops = stored(repeated_lines(docs, min_docs, min_chars, text, keep_first), "lines")
    if keep_first or drops.count() > broadcast_keys:
        return _drop_by_join(docs, drops, text, keep_first)
    keys = np.frombuffer(b"".join(np.array([r.h1, r.h2], np.int64).tobytes() for r in drops.select("h1", "h2").toLocalIterator()), U64).reshape(-1, 2)
    handle = docs.sparkSession.sparkContext.broadcast(_Keys(keys))
    names, at = [*docs.columns, "n_lines", "n_dropped"], docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone = handle.value
        for batch in batches:
            out, n_lines, n_dropped = [], [], []
            column = batch.column(at)
            for whole, x in zip(as_bytes(column), column.is_null().to_pylist(), strict=True):
                keys = line_keys(whole)
                n_lines.append(len(keys))
                full = [i for i, k in enumerate(keys) if k]
                lost = {full[i] for i in np.flatnonzero(gone.hold(_digests([keys[i] for i in full]))).tolist()} if full and len(gone.h1) else ()
                n_dropped.append(len(lost))
                if lost:
                    whole = b"\n".join(line for i, line in enumerate(whole.split(b"\n")) if i not in lost)
                out.append(None if x else whole)
            columns = [pa.array(out, pa.binary()).cast(pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names)

    return in_arrow(docs, apply, schema)


def _drop_by_join(docs: DataFrame, drops: DataFrame, text: str, keep_first: str | None) -> DataFrame:
    """The way beyond broadcast_keys, and of first occurrences. A document is told by its text's hash, as the lines lost depend on
    nothing else, but for first occurrences, which its id decides."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = F.struct(F.xxhash64(F.lit(1), body), F.xxhash64(F.lit(2), body), *([F.col(keep_first)] if keep_first else []))
    held = docs.withColumn("__doc", own)
    key_type = held.schema["__doc"].dataType
    schema = T.StructType([T.StructField("__doc", key_type), *(T.StructField(c, k) for c, k in (("line", T.IntegerType()), ("h1", T.LongType()), ("h2", T.LongType())))])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, lines, found = [], [], []
            for k, x in enumerate(as_bytes(batch.column(1))):
                keys = line_keys(x)
                full = [i for i, key in enumerate(keys) if key]
                which.append(np.full(len(full), k))
                lines.append(np.array(full, np.int32))
                found.append(_digests([keys[i] for i in full]))
            if found:
                h = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(which))), pa.array(np.concatenate(lines)), *(signed(h[:, i].copy()) for i in (0, 1))], schema.names)

    hits = in_arrow(held.select("__doc", body.alias("text")), numbered, schema).join(drops, ["h1", "h2"])
    if keep_first:
        hits = hits.filter(~(F.col(f"__doc.{keep_first}").eqNullSafe(F.col("first.id")) & (F.col("line") == F.col("first.line"))))
    lists = hits.groupBy("__doc").agg(F.collect_set("line").alias("__gone"))
    joined = held.join(lists, "__doc", "left").withColumn("__gone", F.coalesce("__gone", F.array().cast("array<int>"))).withColumn("__lines", F.split(body, "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone")
    kept = F.array_join(F.transform(stay, lambda i: F.get("__lines", i)), "\n")
    columns = [F.when(F.size("__gone") > 0, kept).otherwise(F.col(text)).alias(c) if c == text else F.col(c) for c in docs.columns]
    return joined.select(*columns, F.size("__lines").cast("long").alias("n_lines"), F.size("__gone").cast("long").alias("n_dropped"))


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import read

    kept = drop_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), gone AS (
  SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT keyed.*, gone.k IS NOT NULL AS drop_it FROM keyed LEFT JOIN gone USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE drop_it) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT drop_it), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
