"""Benchmark decontamination by the pigeonhole principle and Myers' bit-parallel edit distance, on words.

An item of n words may differ by e = floor(error_rate * n) word edits. It is split into e + 1 pieces, of which any such copy
holds one unchanged. One pass over the documents looks up the hashes of all word runs that are as long as a piece (its first
PROBE words, if it is longer); around each hit the item is searched with Myers' algorithm, whose bit vectors are Python
integers of n bits. Items are taken in blocks of a bounded number of words; each block is one broadcast and one pass, so a large
benchmark costs passes, not memory.

Words are runs of ASCII letters and digits and of all non-ASCII characters, in lower case. Short items
are searched too, those of fewer than seven words without edits; only items of fewer than min_words words are not.

Results: distance is the least number of edits between the item and any run of the text's words; start_word and end_word are of
the first run to end with it (the shortest of these); places counts runs within the budget from the left, each the earliest to
end behind the one before.

Cases: null and empty texts or items match nothing; a copy cut off at the start or end of a text counts the missing words as
edits; very long texts are searched whole, around their hits; repeated rows give repeated results; null ids are kept; extra
columns are ignored; of equally near places the first counts; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import U64, WORD_BY_ALNUM, Spans, as_bytes, fold, in_arrow, read, word_hashes

PROBE = 5
ERROR_RATE = 0.15
MIN_WORDS = 1
BLOCK_WORDS = 1_000_000


def myers(places: dict[int, int], n: int, text: list[int], enough: int = -1) -> tuple[int, int]:
    """Least edits between a pattern of n words and any run of text, and where the first such run ends (exclusive); stops at the
    first run of at most `enough` edits.

    places: word -> bits of its places in the pattern."""
    full, top = (1 << n) - 1, 1 << (n - 1)
    vp, vn, score, least, end = full, 0, n, n, 0
    for j, word in enumerate(text):
        eq = places.get(word, 0)
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp, hn = vn | (full & ~(d0 | vp)), vp & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp, hn = (hp << 1) & full, (hn << 1) & full
        vp, vn = hn | (full & ~(d0 | hp)), hp & d0
        if score < least:
            least, end = score, j + 1
            if least <= enough:
                break
    return least, end


def _count(places: dict[int, int], n: int, text: list[int], budget: int) -> int:
    """Runs of at most budget edits from the left, each the earliest to end behind the one before."""
    found = 0
    while text:
        edits, end = myers(places, n, text, budget)
        if edits > budget:
            break
        found, text = found + 1, text[max(1, end) :]
    return found


def _bits(words: list[int]) -> dict[int, int]:
    places: dict[int, int] = {}
    for i, w in enumerate(words):
        places[w] = places.get(w, 0) | 1 << i
    return places


class Items:
    """The pieces of a block of items, ready for look-up."""

    def __init__(self, items: list[tuple], error_rate: float = ERROR_RATE, min_words: int = MIN_WORDS):
        """items: (id, text as bytes)."""
        self.items, pieces = [], []
        for item_id, text in items:
            h, _, _ = word_hashes(fold(text), WORD_BY_ALNUM)
            n = len(h)
            if n < max(1, min_words):
                continue
            budget = int(error_rate * n)
            spans = Spans(h)
            for k in range(budget + 1):
                start, stop = k * n // (budget + 1), (k + 1) * n // (budget + 1)
                size = min(PROBE, stop - start)
                pieces.append((size, int(spans.of(np.array([start]), size)[0]), len(self.items), start))
            words = h.tolist()
            self.items.append((item_id, n, budget, _bits(words), _bits(words[::-1])))
        self.by_size = {}
        for size in sorted({p[0] for p in pieces}):
            some = sorted((h, i, start) for s, h, i, start in pieces if s == size)
            found: dict[int, list] = {}
            for h, i, start in some:
                found.setdefault(h, []).append((i, start))
            bits = max(16, (32 * len(found)).bit_length())
            flags = np.zeros(1 << bits, bool)
            flags[np.array(list(found), U64) >> U64(64 - bits)] = True
            self.by_size[size] = (bits, flags, found)

    def search(self, text: bytes) -> list[tuple[int, int, int, int, int]]:
        """(item number, least edits, first word, past-the-end word, places) of each item found."""
        h, _, _ = word_hashes(fold(text), WORD_BY_ALNUM)
        n, guesses = len(h), {}
        spans = Spans(h) if n else None
        for size, (bits, flags, found) in self.by_size.items():
            if n < size:
                continue
            runs = spans.of(np.arange(n - size + 1), size)
            for p in np.flatnonzero(flags[runs >> U64(64 - bits)]).tolist():
                for i, start in found.get(int(runs[p]), ()):
                    guesses.setdefault(i, set()).add(p - start)
        out = []
        for i, at in guesses.items():
            _, size, budget, forward, backward = self.items[i]
            regions: list[list[int]] = []  # what copies at these guesses can reach, where it overlaps as one
            for guess in sorted(at):
                low, high = max(0, guess - budget), min(n, guess + size + budget)
                if regions and low <= regions[-1][1]:
                    regions[-1][1] = max(regions[-1][1], high)
                else:
                    regions.append([low, high])
            best, places = None, 0
            for low, high in regions:
                window = h[low:high].tolist()
                edits, end = myers(forward, size, window)
                if edits > budget:
                    continue
                places += _count(forward, size, window, budget)
                if best is None or edits < best[0]:
                    _, length = myers(backward, size, window[:end][::-1])
                    best = (edits, low + end - length, low + end)
            if best:
                out.append((i, *best, places))
        return sorted(out)


def blocks(benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text", error_rate: float = ERROR_RATE, min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS) -> Iterator[Items]:
    """The benchmark's items in blocks of about block_words words."""
    block, words = [], 0
    for r in benchmark.select(F.col(item_id).alias("i"), F.col(item_text).cast("string").alias("t")).toLocalIterator():
        data = (r.t or "").encode()
        block.append((r.i, data))
        words += len(data) // 4 + 1
        if words > block_words:
            yield Items(block, error_rate, min_words)
            block, words = [], 0
    if block:
        yield Items(block, error_rate, min_words)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", **options) -> DataFrame:
    """(id, item id, distance, start_word, end_word, places): a row for each document and item found in it. options: as for blocks()."""
    kind = to_arrow_type(benchmark.schema[item_id].dataType)
    schema = T.StructType([
        T.StructField(id_column, docs.schema[id_column].dataType), T.StructField(item_id, benchmark.schema[item_id].dataType),
        *(T.StructField(c, T.IntegerType()) for c in ("distance", "start_word", "end_word", "places")),
    ])
    rows = docs.select(F.col(id_column), F.col(text).cast("string"))

    def search(block: Items) -> DataFrame:
        handle = docs.sparkSession.sparkContext.broadcast(block)

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = handle.value
            for batch in batches:
                found = [(k, *hit) for k, x in enumerate(as_bytes(batch.column(1))) for hit in items.search(x)]
                ids = pa.array([items.items[f[1]][0] for f in found], kind)
                numbers = [pa.array([f[i] for f in found], pa.int32()) for i in range(2, 6)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([f[0] for f in found], pa.int64())), ids, *numbers], schema.names)

        return in_arrow(rows, apply, schema)

    out = docs.sparkSession.createDataFrame([], schema)
    for block in blocks(benchmark, item_id, **options):
        out = out.unionByName(search(block))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", **options) -> DataFrame:
    """docs without the rows in which an item is found; one pass over what is left for each block of items, no shuffle."""
    at = docs.columns.index(text)

    def clean(rows: DataFrame, block: Items) -> DataFrame:
        handle = docs.sparkSession.sparkContext.broadcast(block)

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not handle.value.search(x) for x in as_bytes(batch.column(at))], pa.bool_()))

        return in_arrow(rows, apply, docs.schema)

    for block in blocks(benchmark, item_id, **options):
        docs = clean(docs, block)
    return docs


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
