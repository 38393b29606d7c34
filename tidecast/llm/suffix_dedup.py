"""Repeated passages by sparse suffix arrays.

A passage of ``min_words`` (50) words that two documents share holds, among its first WINDOW positions, the same minimiser of
WINDOW hashed runs of GRAM words, so it is enough to keep the suffixes that start at minimisers. Each is told by the 64-bit hash
of its first CORE = min_words - REACH words (REACH = WINDOW - 1), which lie within the passage, and by marks: 31-bit hashes of the
1, 2 ... REACH words behind the core, and of those before it.

1. Suffixes whose core only one document holds are dropped by a twice-seen Bloom filter of bounded size.
2. The rest is sorted twice over the cluster by range: by (core, marks behind) and by (core, marks before), in each with the
   document as the last key, so even a core that a third of all rows share is dealt to many tasks; a range holds about TASK_ROWS
   suffixes. Each is compared with the nearest of another document on either side; for runs that go on in the ranges beside, four
   rows a range tell their neighbours there.
3. A neighbour with `left` words before and `right` words behind in common confirms the passages that start 0 to `left` words
   before the core and need at most `right` words behind it: a set of bits, joined over all neighbours.
4. Over both orders the longest reaches tell which passages may be shared besides: with the left reach of one neighbour and the
   right reach of another. These few are settled exactly: all suffixes of their cores meet by (core, marks before, marks behind).

So all passages that two documents share are found, and no others: a passage is equal by a 64-bit and two 31-bit hashes.
Overlapping ones are joined.

Words are as in decontamination: letters, digits and non-ASCII characters, in lower case.

Cases: null, empty and short texts hold no passage; very long texts are taken whole; rows that agree in id and text are one
document; null ids are kept, told apart by their text; extra columns are ignored, whatever their names; an empty table gives an
empty table.
"""

from __future__ import annotations

import zlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import U64, WORD_BY_ALNUM, Spans, TwiceFilter, as_bytes, discard, filter_bits, fold, in_arrow, mix, read, rest, signed, stored, word_hashes

MIN_WORDS = 50
WINDOW, GRAM = 16, 8
REACH = WINDOW - 1
TASK_ROWS, RANGES = 200_000, 4  # rows of a range, ranges of a task


def minimisers(spans: Spans, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """First places of the least hash of each window of runs of gram words."""
    n = spans.n - gram + 1
    if n < window:
        return np.zeros(0, np.int64)
    least, place = spans.of(np.arange(n), gram), np.arange(n)
    size = 1
    while size < window:  # least of size, doubled; of equal ones the first
        step = min(size, window - size)
        later = least[step:] < least[:-step]
        least, place = np.where(later, least[step:], least[:-step]), np.where(later, place[step:], place[:-step])
        size += step
    return place[np.concatenate([[True], place[1:] != place[:-1]])]  # places never go back


def suffixes(text: bytes, min_words: int) -> tuple[Spans, np.ndarray, np.ndarray]:
    """Spans of the words, kept places and their core hashes of one text."""
    h, _, _ = word_hashes(fold(text), WORD_BY_ALNUM)
    spans, core = Spans(h), min_words - REACH
    if len(h) < min_words:
        return spans, np.zeros(0, np.int64), np.zeros(0, U64)
    at = minimisers(spans)
    at = at[at + core <= len(h)]
    return spans, at, spans.of(at, core)


def _around(spans: Spans, at: np.ndarray, core: int) -> tuple[np.ndarray, np.ndarray]:
    """Marks, never 0, of the 1 to REACH words behind the core and before it; 0 beyond the text."""
    steps = np.arange(1, REACH + 1)
    behind, before = at[:, None] + core + np.zeros(REACH, np.int64), at[:, None] - steps
    marks = []
    for start, inside in ((behind, behind + steps <= spans.n), (before, before >= 0)):
        whole = spans.each(np.where(inside, start, 0), np.where(inside, steps, 0))
        marks.append(np.where(inside, (whole >> U64(32)).astype(np.uint32) | np.uint32(1), np.uint32(0)))
    return marks[0], marks[1]


def _suspects(docs: DataFrame, id_column: str, text: str, min_words: int) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = docs.select(body.alias("text"))
    n = (texts.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0) // 45  # about one kept suffix in so many bytes
    seen = TwiceFilter.build(texts, lambda x: np.unique(suffixes(x, min_words)[2]), filter_bits(n))
    core = min_words - REACH
    id_field = T.StructField("id", docs.schema[id_column].dataType)
    schema = T.StructType([id_field, *(T.StructField(c, T.LongType()) for c in ("text_hash", "core")), T.StructField("place", T.IntegerType()), T.StructField("after", T.BinaryType()), T.StructField("before", T.BinaryType())])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 4 * REACH
        cut = lambda m: pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(m), [None, pa.py_buffer(np.ascontiguousarray(m.astype(">u4")))]).cast(pa.binary())
        for batch in batches:
            parts = []
            for k, x in enumerate(as_bytes(batch.column(2))):
                spans, at, cores = suffixes(x, min_words)
                held = seen(cores)
                if held.any():
                    at = at[held]
                    parts.append((np.full(len(at), k), at, cores[held], *_around(spans, at, core)))
            if parts:
                which, at, cores, after, before = (np.concatenate(p) for p in zip(*parts, strict=True))
                rows = pa.array(which)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), signed(cores), pa.array(at.astype(np.int32)), cut(after), cut(before)], schema.names)

    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(body).alias("text_hash"), body.alias("text"))
    return in_arrow(rows, keep, schema)


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of words that agree; what lies beyond a text agrees with nothing."""
    same = (a == b) & (a != 0)
    return np.where(same.all(axis=1), REACH, same.argmin(axis=1))


def _bits(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bit l for each l up to left for which REACH - l is at most right: the passages that start l words before a core."""
    low = np.maximum(REACH - right, 0)
    return np.where(left >= low, (2 << left) - (1 << low), 0).astype(np.int32)


_FIRST, _LAST, _TOLD = 1, 2, (4, 8, 16, 32)  # in a task's first run, in its last; first row, the one behind the first run, the one before the last, last row


_FOUND = ["id", "text_hash", "core", "place", "left", "right", "bits", "other"]


def _files(suspects: DataFrame) -> int:
    """So many that a task takes RANGES times TASK_ROWS suffixes at most."""
    return suspects.count() // (RANGES * TASK_ROWS) + 1


def _neighbours(suspects: DataFrame, order: list[str]) -> DataFrame:
    """(id, text_hash, core, place, left, right, bits, other): what each suffix shares with its neighbours in one order; other is the
    neighbour that shares most words before."""
    parts = max(int(suspects.sparkSession.conf.get("spark.sql.shuffle.partitions")), RANGES * _files(suspects))
    keys = [*order, "id", "text_hash"]
    # the number of the range goes with its rows, as a task may take several ranges one after the other
    dealt = suspects.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("range", F.spark_partition_id())
    id_type = suspects.schema["id"].dataType
    edge = T.StructType([suspects.schema["id"], *(suspects.schema[c] for c in ("text_hash", "core", "place", "after", "before"))])
    number = lambda *names: [T.StructField(c, T.IntegerType()) for c in names]
    schema = T.StructType([T.StructField("id", id_type), T.StructField("text_hash", T.LongType()), T.StructField("core", T.LongType()), *number("place", "left", "right", "bits"), T.StructField("other", id_type), *number("task", "flags"), T.StructField("edge", edge)])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        n, task = t.num_rows, t.column("range")[0].as_py()
        column = lambda c: t.column(c).combine_chunks() if t.column(c).num_chunks != 1 else t.column(c).chunk(0)
        core, doc = column("core").to_numpy(), column("text_hash").to_numpy().view(np.uint64) ^ _id_hash(t.column("id"))
        after, before = (np.frombuffer(b"".join(t.column(c).to_pylist()), ">u4").reshape(n, REACH) for c in ("after", "before"))
        left, right, bits, other = np.full(n, -1), np.full(n, -1), np.zeros(n, np.int32), np.zeros(n, np.int64)
        fresh = np.concatenate([[True], (core[1:] != core[:-1]) | (doc[1:] != doc[:-1])])  # a run: one document's suffixes of one core
        run, starts = np.cumsum(fresh) - 1, np.append(np.flatnonzero(fresh), n)
        for with_ in (starts[run] - 1, starts[run + 1]):
            at = np.flatnonzero((with_ >= 0) & (with_ < n))
            at = at[core[at] == core[with_[at]]]
            b = with_[at]
            r, l = _shared(after[at], after[b]), _shared(before[at], before[b])
            some = _bits(l, r)
            best = some > bits[at]  # the highest bit is the passage that starts first
            other[at[best]] = b[best]
            bits[at] |= some
            right[at], left[at] = np.maximum(right[at], r), np.maximum(left[at], l)
        found = np.flatnonzero(right >= 0)
        rows, whole = pa.array(found), lambda x: pa.array(x[found].astype(np.int32))
        struct = lambda rows: pa.StructArray.from_arrays([column(f.name).take(rows) for f in edge], names=[f.name for f in edge])
        zeros = pa.array(np.zeros(len(found), np.int32))
        known = [*(column(c).take(rows) for c in ("id", "text_hash", "core", "place")), whole(left), whole(right), whole(bits), column("id").take(pa.array(other[found]))]
        yield pa.RecordBatch.from_arrays([*known, zeros, zeros, pa.nulls(len(found), struct(rows[:0]).type)], schema.names)
        flags = (run == 0) * _FIRST | (run == run[-1]) * _LAST
        for bit, at in zip(_TOLD, (0, starts[1], starts[-2] - 1, n - 1), strict=True):
            if 0 <= at < n:
                flags[at] |= bit
        ends = np.flatnonzero(flags)
        nothing = [pa.nulls(len(ends), x.type) for x in known]
        yield pa.RecordBatch.from_arrays([*nothing, pa.array(np.full(len(ends), task, np.int32)), pa.array(flags[ends].astype(np.int32)), struct(pa.array(ends))], schema.names)

    rest(suspects.sparkSession)
    found = stored(in_arrow(dealt, compare, schema), "neighbours", files=_files(suspects))
    edges = found.filter("flags > 0").select("task", "flags", "edge.*")
    out = found.filter("flags = 0").select(*_FOUND).unionByName(_across(edges, T.StructType([schema[c] for c in _FOUND])))
    out._stored_at = found._stored_at
    return out


def _id_hash(ids: pa.ChunkedArray) -> np.ndarray:
    if pa.types.is_integer(ids.type):
        return mix(ids.fill_null(-1).to_numpy().astype(np.int64).view(np.uint64))
    return np.array([zlib.crc32(repr(x).encode()) | zlib.adler32(repr(x).encode()) << 32 for x in ids.to_pylist()], U64)


def _across(edges: DataFrame, schema: T.StructType) -> DataFrame:
    """What the first and last run of each task share with the nearest row of another document in the tasks beside. Four rows of a
    task come to the driver; the runs stay where they are stored."""
    told: dict[int, list] = {}
    for r in edges.filter(F.col("flags") >= _TOLD[0]).collect():
        four = told.setdefault(r.task, [None] * 4)
        for i, bit in enumerate(_TOLD):
            if r.flags & bit:
                four[i] = r
    tasks = sorted(told)
    run_of = lambda r: (r.core, r.id, r.text_hash)
    beside: dict[int, list] = {t: [None, None] for t in tasks}
    for side, line, near, behind, own in ((0, tasks, 3, 2, 0), (1, tasks[::-1], 0, 1, 3)):
        last = None  # the row beside the task, and the nearest one of another run than this row's
        other = None
        for t in line:
            mine = told[t][own]
            found = other if last is not None and run_of(last) == run_of(mine) else last
            if found is not None and found.core == mine.core:
                beside[t][side] = (bytes(found.after), bytes(found.before), found.id)
            reach = told[t][near]
            inner = told[t][behind]
            if inner is None:  # one run fills the task
                other = other if last is not None and run_of(last) == run_of(reach) else last
            else:
                other = inner
            last = reach
    handle = edges.sparkSession.sparkContext.broadcast({t: x for t, x in beside.items() if any(x)})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = lambda x: np.frombuffer(x, ">u4").reshape(-1, REACH)
        for batch in batches:
            task, flags = (batch.column(c).to_numpy() for c in ("task", "flags"))
            after, before = (marks(b"".join(batch.column(c).to_pylist())) for c in ("after", "before"))
            for t in np.unique(task).tolist():
                for bit, one in zip((_FIRST, _LAST), handle.value.get(t, (None, None)), strict=True):
                    at = np.flatnonzero((task == t) & (flags & bit > 0))
                    if one and len(at):
                        r, l = _shared(after[at], marks(one[0])), _shared(before[at], marks(one[1]))
                        rows = pa.array(at)
                        numbers = [pa.array(x.astype(np.int32)) for x in (l, r, _bits(l, r))]
                        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in ("id", "text_hash", "core", "place")), *numbers, pa.array([one[2]] * len(at), batch.column("id").type)], schema.names)

    return in_arrow(edges, compare, schema)


def _settled(best: DataFrame, suspects: DataFrame) -> DataFrame:
    """(id, text_hash, place, bits, other) of passages that two documents hold, of the cores with a suffix whose reaches allow a passage
    that no neighbour alone confirms. Both sides of each join are tables, so a core that many documents hold is a join that can be split."""
    low = F.greatest(F.lit(REACH) - F.col("right"), F.lit(0))
    power = lambda c: F.call_function("shiftleft", F.lit(1), c)
    may = F.when(F.col("left") >= low, (power(F.col("left") + 1) - power(low)).bitwiseAND(F.bitwise_not("bits"))).otherwise(0)
    cores = stored(best.withColumn("open", may).filter("open != 0").groupBy("core").agg(F.bit_or("open").alias("open")), "cores", files=1)
    each = suspects.join(cores, "core").withColumn("l", F.explode(F.filter(F.sequence(F.lit(0), F.lit(REACH)), lambda i: F.call_function("getbit", F.col("open"), i) == 1)))
    none, beyond = F.unhex(F.lit("")), F.unhex(F.lit("00000000"))
    last = lambda c, size: F.when(size > 0, F.substring(F.col(c), 4 * size - 3, F.lit(4))).otherwise(none)  # noqa: E731  the mark of so many words
    key = F.struct("core", "l", last("before", F.col("l")).alias("before"), last("after", REACH - F.col("l")).alias("after"))
    passages = stored(each.select("id", "text_hash", "place", key.alias("key")).filter((F.col("key.before") != beyond) & (F.col("key.after") != beyond)), "passages", files=_files(suspects))
    doc = F.struct("text_hash", "id")
    shared = stored(passages.groupBy("key").agg(F.min(doc).alias("a"), F.max(doc).alias("b")).filter(~F.col("a").eqNullSafe(F.col("b"))), "shared", files=1)
    other = F.when(F.col("a").eqNullSafe(doc), F.col("b.id")).otherwise(F.col("a.id"))
    return passages.join(shared, "key").select("id", "text_hash", "place", power(F.col("key.l")).alias("bits"), other.alias("other"))


def repeated_passages(docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, passages, n_repeated): a row for each document with a passage of min_words or more that another document holds.

    passages: array of (start, end, other), words from 0, end exclusive; other is the id of a document that shares its start."""
    if min_words < WINDOW + GRAM + REACH:
        raise ValueError(f"min_words must be {WINDOW + GRAM + REACH} or more")
    rest(docs.sparkSession)
    suspects = stored(_suspects(docs, id_column, text, min_words), "suffixes")
    orders = [_neighbours(suspects, order) for order in (["core", "after", "before"], ["core", "before", "after"])]
    best = stored(orders[0].unionByName(orders[1]).groupBy("id", "text_hash", "core", "place").agg(
        F.max("left").alias("left"), F.max("right").alias("right"), F.bit_or("bits").alias("bits"), F.max_by("other", "bits").alias("other")
    ), "reaches", files=_files(suspects))
    discard(*orders)
    found = best.filter("bits != 0").select("id", "text_hash", "place", "bits", "other").unionByName(_settled(best, suspects))
    held = found.groupBy("id", "text_hash").agg(F.collect_list(F.struct("place", "bits", "other")).alias("found"))
    kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("other", docs.schema[id_column].dataType)]))
    schema = T.StructType([T.StructField(id_column, docs.schema[id_column].dataType), T.StructField("passages", kind), T.StructField("n_repeated", T.LongType())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            found = lists.flatten()
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            place, bits = (found.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("place", "bits"))
            which, l = np.nonzero(bits[:, None] >> np.arange(REACH + 1) & 1)  # a passage each: row of found, words before its core
            top = bits[which] >> (l + 1) == 0  # the other document is told for the passage that starts first
            start, doc = place[which] - l, row[which]
            order = np.lexsort((~top, start, doc))
            which, start, doc = which[order], start[order], doc[order]
            fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + min_words)]) if len(doc) else np.zeros(0, bool)
            first = np.flatnonzero(fresh)
            last = np.append(first[1:], len(doc))[: len(first)] - 1
            begin, end = start[first], start[last] + min_words
            counts = np.bincount(doc[first], minlength=len(lists))
            parts = [pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32)), found.field("other").take(pa.array(which[first]))]
            merged = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.StructArray.from_arrays(parts, fields=list(to_arrow_type(kind).value_type)))
            total = np.bincount(doc[first], (end - begin).astype(float), minlength=len(lists)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), merged, pa.array(total)], schema.names)

    return in_arrow(held.select("id", "found"), join, schema)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = repeated_passages(read(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("passages", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", F.size("passages").cast("long").alias("n_passages"), "n_repeated", spans.alias("spans"), F.array_distinct(F.transform("passages", lambda s: s["other"])).alias("other_docs"))
