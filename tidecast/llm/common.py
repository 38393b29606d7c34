"""What the text operators share: scratch storage, vectorised word hashing and the twice-seen Bloom filter."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C55)
_BASE_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240601)).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]

#: Bytes that separate words: white space only, or everything but letters, digits and non-ASCII bytes.
SPACE_BYTES = bytes([0x20, 9, 10, 11, 12, 13])
WORD_BY_SPACE = np.array([b not in SPACE_BYTES for b in range(256)])
WORD_BY_ALNUM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


# --- storage -----------------------------------------------------------------


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster. A temporary one of our own only where the session names none and runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        held = context._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidecast-")
        context.setCheckpointDir(root)
    return root


def stored(df: DataFrame, name: str, files: int = 0) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends here and survives lost executors.

    files: rows of a few numbers, written in at most four files for each core of the cluster, or in so many where that is more."""
    if files:
        df = few_files(df, files)
    path = f"{scratch_dir(df.sparkSession)}/tidecast/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def few_files(df: DataFrame, least: int = 1) -> DataFrame:
    """Rows of a few numbers in at most four partitions for each core of the cluster, but at least `least`; each written file costs the file
    system a round trip or more."""
    return df.coalesce(max(least, 4 * df.sparkSession.sparkContext.defaultParallelism))


def discard(*frames: DataFrame | None) -> None:
    """Deletes what stored() wrote for these; nothing that is still to run may read them."""
    for df in frames:
        path = getattr(df, "_stored_at", None)
        if path:
            context = df.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of a batch where the session leaves Spark's own sizes (10,000 for Arrow, 4,096 for Parquet): texts may be long, and a batch is
#: held by the JVM and by Python.
BATCH_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", 512), "spark.sql.parquet.columnarReaderBatchSize": ("4096", 512)}


def small_batches(spark: SparkSession) -> None:
    for key, (usual, rows) in BATCH_ROWS.items():
        if spark.conf.get(key) == usual:
            spark.conf.set(key, rows)


def in_arrow(df: DataFrame, function, schema) -> DataFrame:
    """df.mapInArrow(function, schema) in batches of BATCH_ROWS rows, unless the session asks for sizes of its own. A worker, which Spark keeps
    for later tasks, gives its memory back when the task's rows are out."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Freed memory goes back to the system; where the C library has no such call, only Arrow's does."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def rest(spark: SparkSession) -> None:
    """Has the executors collect their garbage, so that the heap that one step has grown goes back to the system before the next, whose
    Python workers share the machine with it. A task for each core and as many again, so that every executor is likely to get one."""
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("x")).write.format("noop").mode("overwrite").save()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --- bytes and words ---------------------------------------------------------


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def fold(text: bytes) -> bytes:
    """The text in lower case, all letters."""
    return text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the finaliser of SplitMix64)."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n at least."""
    if len(_powers[0]) <= n:
        size = max(1 << 16, 1 << (n + 1).bit_length())
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            _powers[k] = np.concatenate([np.ones(1, U64), np.cumprod(np.full(size, base, U64))])
    return _powers[0], _powers[1]


def word_bounds(data: bytes, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end byte of each word."""
    flags = np.zeros(len(data) + 2, np.int8)
    flags[1:-1] = is_word[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(flags[1:] != flags[:-1])
    return edges[0::2], edges[1::2]


def word_hashes(data: bytes, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash of each word, with its bounds; equal words have equal hashes in any text and process."""
    starts, ends = word_bounds(data, is_word)
    if not len(starts):
        return np.zeros(0, U64), starts, ends
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE_VALUES[np.frombuffer(data, np.uint8)] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64)), starts, ends


class Spans:
    """Hashes of any run of words of one text in constant time."""

    def __init__(self, hashes: np.ndarray):
        self.n = len(hashes)
        up, self._down = powers(self.n)
        self._total = np.zeros(self.n + 1, U64)
        np.cumsum(hashes * up[: self.n], out=self._total[1:])

    def of(self, start: np.ndarray, length: int) -> np.ndarray:
        return mix((self._total[start + length] - self._total[start]) * self._down[start] + U64(length))

    def each(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """As of(), with a length for each start."""
        return mix((self._total[start + length] - self._total[start]) * self._down[start] + length.astype(U64))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; of all words where there are fewer; nothing for no words."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(k, n)
    return Spans(hashes).of(np.arange(n - size + 1), size)


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64), pa.int64())


# --- twice-seen filter -------------------------------------------------------

_BLOCK = 1 << 17  # bits
MIN_BITS, MAX_BITS = 1 << 17, 1 << 29


def filter_bits(keys: int) -> int:
    """Size for so many keys at about 12 bits each, a power of two; MAX_BITS (64 MB) is the proven bound of what is broadcast.

    Beyond it the filter only grows fuller: more keys are suspected and shuffled, and the exact step still settles them."""
    return min(MAX_BITS, max(MIN_BITS, 1 << max(0, 12 * keys - 1).bit_length()))


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    top = U64(bits - 1)
    return (h & top).astype(np.int64), ((h >> U64(29)) * U64(0x9E3779B97F4A7C15) >> U64(33) & top).astype(np.int64)


def _test(flags: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    a, b = _places(h, bits)
    return ((flags[a >> 3] >> (a & 7).astype(np.uint8)) & (flags[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)


def _put(flags: np.ndarray, h: np.ndarray, bits: int) -> None:
    for at in _places(h, bits):
        np.bitwise_or.at(flags, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))


class TwiceFilter:
    """Bloom filter of the 64-bit keys that at least two documents hold (and a few more)."""

    def __init__(self, handle, bits: int):
        self.handle, self.bits = handle, bits

    def __call__(self, h: np.ndarray) -> np.ndarray:
        return _test(self.handle.value, h, self.bits) if len(h) else np.zeros(0, bool)

    @classmethod
    def build(cls, texts: DataFrame, keys_of: Callable[[bytes], np.ndarray], bits: int) -> TwiceFilter:
        """keys_of: a text's distinct keys. Every task fills a once-seen and a twice-seen filter of its own; the blocks of
        all tasks meet by number and are merged as a stream: what two tasks have each seen once has been seen twice."""

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            once, twice, held = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8), False

            def take(found: list[np.ndarray]) -> None:
                h, n = np.unique(np.concatenate(found), return_counts=True)
                again = (n > 1) | _test(once, h, bits)
                _put(twice, h[again], bits)
                _put(once, h, bits)

            for batch in batches:
                found, size = [], 0
                for text in as_bytes(batch.column(0)):
                    found.append(keys_of(text))
                    size += len(found[-1])
                    if size > 1 << 20:
                        take(found)
                        found, size = [], 0
                    held = True
                if found:
                    take(found)
            if held:
                step = _BLOCK // 8
                for k in range(0, bits // 8, step):
                    if once[k : k + step].any():
                        row = [zlib.compress(x[k : k + step].tobytes(), 1) for x in (once, twice)]
                        yield pa.RecordBatch.from_arrays([pa.array([k // step], pa.int32()), *(pa.array([x], pa.binary()) for x in row)], ["block", "once", "twice"])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, once, twice = None, None, None
            out = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())], ["block", "twice"])
            for batch in batches:
                for k, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
                    if k != at:
                        if at is not None and twice.any():
                            yield out()
                        at, once, twice = k, a.copy(), b.copy()
                    else:
                        twice |= b | (once & a)
                        once |= a
            if at is not None and twice.any():
                yield out()

        blocks = in_arrow(texts, fill, "block int, once binary, twice binary")
        merged = in_arrow(blocks.repartition("block").sortWithinPartitions("block"), merge, "block int, twice binary")
        flags = np.zeros(bits // 8, np.uint8)
        for row in merged.collect():  # at most MAX_BITS
            flags[row.block * _BLOCK // 8 : (row.block + 1) * _BLOCK // 8] = np.frombuffer(zlib.decompress(row.twice), np.uint8)
        return cls(texts.sparkSession.sparkContext.broadcast(flags), bits)


def line_count(texts: DataFrame, column: str = "text") -> int:
    """Lines of all texts; only sizes the filter."""
    c = F.coalesce(F.col(column), F.lit(""))
    return texts.agg(F.sum(F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1).alias("n")).first().n or 0
