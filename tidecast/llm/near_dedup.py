"""Near-duplicate classes by Order MinHash with banded alignment.

Similarity: two texts are linked when their sets of 5-word shingles have a Jaccard similarity of 0.8 or more and their word
sequences, aligned in a band, an edit similarity of 0.8 or more. A class is a connected group of links; its id is its least
document id. Words are runs between ASCII white space, in lower case; a text of fewer than five words is one shingle, and one
without words is linked to nothing but its copies.

1. Texts of equal folded word sequences are one node, found by a plain aggregation of its hash.
2. A sketch of a node takes the LEAST occurrence-labelled shingles with the smallest hashes and joins them in text order, so it
   is sensitive to edits and to order; each node has SKETCHES of them, with hashes of their own. A node of at most SHORT
   distinct shingles has as many sketches of the two smallest hashes instead; one near that size has both kinds, so any two
   nodes that can be a link have a kind in common. Two short nodes that are a link share none with a chance below 1e-9.
3. Nodes that share a sketch form a bucket. A node that holds too many shingles of its own to reach any pair's similarity
   leaves first. Then the nodes of a bucket meet in rounds: its one leader with all, eight leaders (of each salt the node with
   the fewest shingles of its own) with all, at last all with all. A pair counts only while its nodes are in two components, so
   a group of n near copies costs a few n verifications, and only where a bound on its similarity does not rule it out: the
   shingles of their own and the parities of the others (PARITIES bits a node) tell a least number of shingles that the two do
   not share. So each pair of a bucket is verified, or within a component, or surely no link. Bounds are a few machine words a
   pair within the join; texts move only for pairs that pass, a leader's once for each of CHUNKS parts of its pairs.
4. Links become classes by least labels with pointer jumping, all in joins and aggregations.

Costs: nodes that share a bucket and stay apart cost their product in bounds, not in texts. Skewed buckets, hubs and labels are
sides of plain equi-joins of two exchanges, which adaptive execution splits.

Cases: a null text is an empty one; texts without words are linked to nothing but their copies; very long texts are sketched
and compared whole; repeated rows are copies; null ids are kept (a class with ids takes the least one, else its id is null);
extra columns are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, WORD_BY_SPACE, TwiceFilter, as_bytes, discard, few_files, filter_bits, fold, in_arrow, mix, read, rest, shingles, stored, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
LEAST = 5
SKETCHES = 24
SHORT = 25
PARITIES = 512
LEADERS = (1, 8, None)  # of a bucket, by round; None: all
CHUNKS = 4096
SKETCH_CELLS = 1 << 20
TASK_NODES = 50_000  # documents whose nodes, sketches and buckets a task writes at most
_SEEDS = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, SKETCHES, dtype=np.uint64)


def text_words(text: bytes) -> np.ndarray:
    return word_hashes(fold(text), WORD_BY_SPACE)[0]


def labelled(runs: np.ndarray) -> np.ndarray:
    """Each shingle's hash with the number of its earlier occurrences mixed in."""
    order = np.argsort(runs, kind="stable")
    ordered = runs[order]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(runs)), 0))
    nth = np.empty(len(runs), np.int64)
    nth[order] = np.arange(len(runs)) - first
    return np.where(nth > 0, mix(runs + nth.astype(U64) * U64(0x9E3779B97F4A7C15)), runs)


def sketches(words: np.ndarray) -> np.ndarray:
    """SKETCHES hashes of a text with words, of each kind that its number of distinct shingles asks for."""
    runs = shingles(words, SHINGLE)
    distinct = np.unique(runs)
    out = []
    if len(distinct) <= SHORT:
        out.append(_sketches(distinct, 2, SKETCHES))
    if len(distinct) >= SIMILARITY * SHORT:
        out.append(_sketches(labelled(runs), LEAST, 0))
    return np.concatenate(out)


def _sketches(runs: np.ndarray, least: int, kind: int) -> np.ndarray:
    """All seeds at once, as far as SKETCH_CELLS numbers go."""
    m, step = min(least, len(runs)), max(1, SKETCH_CELLS // len(runs))
    out = np.empty(SKETCHES, U64)
    for k in range(0, SKETCHES, step):
        h = (runs[None, :] ^ _SEEDS[k : k + step, None]) * U64(0xD6E8FEB86659FD93)
        h ^= h >> U64(32)
        h *= U64(0xD6E8FEB86659FD93)
        at = np.sort(np.argpartition(h, m - 1, axis=1)[:, :m], axis=1)  # in text order
        value = np.arange(kind + k + 1, kind + k + len(h) + 1).astype(U64)
        for column in runs[at].T:
            value = value * U64(0x9E3779B97F4A7C15) + column
            value ^= value >> U64(29)
        out[k : k + step] = value
    return out


def jaccard(a: np.ndarray, b: np.ndarray, shingles_of_a: np.ndarray | None = None) -> float:
    x = np.unique(shingles(a, SHINGLE)) if shingles_of_a is None else shingles_of_a
    y = np.unique(shingles(b, SHINGLE))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def edits_within(a: np.ndarray, b: np.ndarray, band: int) -> int | None:
    """Word edits between a and b if at most band, by furthest-reaching points on the diagonals of the band."""
    n, m = len(a), len(b)
    if abs(n - m) > band:
        return None
    stops: dict[int, np.ndarray] = {}  # by diagonal d: places i where a[i] != b[i + d], then the end

    def slide(d: int, i: int) -> int:
        if d not in stops:
            low, high = max(0, -d), min(n, m - d)
            stops[d] = np.append(low + np.flatnonzero(a[low:high] != b[low + d : high + d]), high)
        at = stops[d]
        return int(at[np.searchsorted(at, i)]) if i <= at[-1] else i

    reach = {0: slide(0, 0)}
    for e in range(band + 1):
        if reach.get(m - n, -1) >= n:
            return e
        after = {}
        for d in range(max(-e - 1, -band), min(e + 1, band) + 1):
            i = max(reach.get(d, -2) + 1, reach.get(d - 1, -2), reach.get(d + 1, -2) + 1)  # change, insert, delete
            i = min(i, n, m - d)
            if i >= max(0, -d):
                after[d] = slide(d, i)
        reach = after
    return None


def alike(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY, shingles_of_a: np.ndarray | None = None) -> bool:
    if not len(a) or not len(b) or jaccard(a, b, shingles_of_a) < similarity:
        return False
    longest = max(len(a), len(b))
    return edits_within(a, b, int((1 - similarity) * longest + 1e-9)) is not None


def _copy(text: str) -> Column:
    """128 bits of the text's SHA-256."""
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256), 1, 32))


def nodes_of(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, copy, node, sketches) by row: copy tells the text, node its folded words; sketches are null for texts without words."""
    rows = docs.select(F.col(id_column).alias("id"), _copy(text).alias("copy"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    schema = f"id {docs.schema[id_column].dataType.simpleString()}, copy binary, node binary, sketches array<bigint>"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, names = [], []
            for x, copy in zip(as_bytes(batch.column(2)), batch.column(1).to_pylist(), strict=True):
                words = text_words(x)
                found.append(sketches(words).view(np.int64) if len(words) else None)
                names.append(hashlib.sha256(b" ".join(fold(x).split())).digest()[:16] if len(words) else copy)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.binary()), pa.array(found, pa.list_(pa.int64()))], ["id", "copy", "node", "sketches"])

    return in_arrow(rows, apply, schema)


def _verify(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(u, v) of the pairs that are alike. The pairs of a u are dealt to CHUNKS parts by v; u's text goes once to each part that it
    has pairs in, where the texts of its partners follow as a stream."""
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(CHUNKS)))
    of = lambda c: texts.select(F.col("node").alias(c), "text")
    heads = dealt.select("u", "part").distinct().join(of("u"), "u").select("u", "part", F.lit(None).cast("binary").alias("v"), "text")
    rest = dealt.join(of("v"), "v").select("u", "part", "v", "text")
    ordered = heads.unionByName(rest).repartition("u", "part").sortWithinPartitions("u", "part", "v")  # the text of u first

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held = None
        for batch in batches:
            kept = []
            for k, (v, x) in enumerate(zip(batch.column(2).to_pylist(), as_bytes(batch.column(3)), strict=True)):
                other = text_words(x)
                if v is None:
                    words, held = other, np.unique(shingles(other, SHINGLE))
                elif alike(words, other, similarity, held):
                    kept.append(k)
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at)], ["u", "v"])

    return in_arrow(ordered, apply, "u binary, v binary")


_MARKS = [f"m{i}" for i in range(PARITIES // 64)]


def _parities(runs: np.ndarray) -> np.ndarray:
    """PARITIES bits: whether an odd number of the shingles falls on each. Two sets differ in as many shingles as bits, or more."""
    at = np.bincount((mix(runs) >> U64(64 - (PARITIES.bit_length() - 1))).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(at.astype(np.uint8)).view(np.int64)


def _able(texts: DataFrame, similarity: float) -> DataFrame:
    """(node, rarity, size, lost, words, parities): the texts that can have a link. A shingle that no other text holds is lost to every pair, so a
    text with over 1 - similarity of such shingles reaches no pair's similarity; a twice-seen filter of bounded size tells most of
    them. rarity, the share of such shingles, is low for the middle of a group of near copies. size counts a text's shingles, lost
    those of its own; the parities are of all others."""
    n = (texts.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0) // 5  # about one shingle a word
    twice = TwiceFilter.build(texts.select("text"), lambda x: np.unique(shingles(text_words(x), SHINGLE)), filter_bits(n))
    names = ["node", "rarity", "size", "lost", "words", *_MARKS]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, out, marks = [], [], []
            for k, x in enumerate(as_bytes(batch.column(1))):
                words = text_words(x)
                h = np.unique(shingles(words, SHINGLE))
                common = h[twice(h)]
                lost = len(h) - len(common)
                if lost <= (1 - similarity) * len(h) + 1e-9:
                    kept.append(k)
                    out.append((lost / len(h), len(h), lost, len(words)))
                    marks.append(_parities(common))
            columns = zip(*out, strict=True) if out else ((),) * 4
            kinds = (pa.float64(), *(pa.int32(),) * 3)
            bits = np.stack(marks) if marks else np.zeros((0, len(_MARKS)), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), *(pa.array(bits[:, i]) for i in range(len(_MARKS)))], names)

    return in_arrow(texts.select("node", "text"), apply, "node binary, rarity double, size int, lost int, words int, " + ", ".join(f"{m} long" for m in _MARKS))


def _possible(a: Callable[[str], Column], b: Callable[[str], Column], similarity: float) -> Column:
    """False only where two nodes are surely no link: lengths too far apart, too few shingles that others hold, or too many shingles
    that only one of the two holds (those of their own, and one or more for each parity that differs)."""
    both = F.least(a("size") - a("lost"), b("size") - b("lost"))
    total = a("size") + b("size")
    far = F.abs(a("words") - b("words")) > (1 - similarity) * F.greatest(a("words"), b("words")) + 1e-6
    apart = sum((F.bit_count(a(m).bitwiseXOR(b(m))) for m in _MARKS), a("lost") + b("lost"))
    return ~far & (both + 1e-6 >= similarity * (total - both)) & (apart <= (1 - similarity) / (1 + similarity) * total + 1e-6)


def links(docs: DataFrame, nodes: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(node, label): the components that the verified pairs of different nodes make."""
    files = nodes.count() // TASK_NODES + 1
    each = nodes.filter(F.col("sketches").isNotNull()).groupBy("node").agg(F.first("sketches").alias("sketches"), F.min("copy").alias("copy"))
    members = each.select("node", "copy", F.explode("sketches").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    involved = stored(members.join(shared, "bucket").select("bucket", "node", "copy"), "buckets", files=files)
    # copies of a text are one before it is shuffled
    bodies = docs.select(_copy(text).alias("copy"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).groupBy("copy").agg(F.first("text").alias("text"))
    texts = stored(bodies.join(involved.select("copy", "node").distinct(), "copy").select("node", "text"), "texts")
    rest(docs.sparkSession)
    able = stored(_able(texts, similarity), "able", files=files)
    left = stored(_open(involved.select("bucket", "node").join(able, "node").withColumn("comp", F.col("node"))), "buckets", files=files)
    discard(involved, able)
    labels, tried, done = None, None, []
    rest(docs.sparkSession)
    for leaders in LEADERS:
        if left.isEmpty():
            break
        m, l = (lambda c: F.col(f"m.{c}")), (lambda c: F.col(f"l.{c}"))
        new = (m("comp") != l("comp")) & _possible(m, l, similarity)
        rows = left.alias("m")
        if leaders:
            salt = F.pmod(F.xxhash64("node", F.lit(leaders)), F.lit(leaders)).alias("salt")
            head = left.groupBy("bucket", salt).agg(F.min(F.struct("rarity", *(c for c in left.columns if c not in ("bucket", "rarity")))).alias("l")).select("bucket", "l.*")
            met = rows.join(head.alias("l"), (m("bucket") == l("bucket")) & new)
        else:
            met = rows.join(left.alias("l"), (m("bucket") == l("bucket")) & (m("node") < l("node")) & new)
        # the node with fewer shingles of its own first: it is in most pairs of its group
        first = F.struct(m("rarity"), m("node")) < F.struct(l("rarity"), l("node"))
        pairs = met.select(F.when(first, m("node")).otherwise(l("node")).alias("u"), F.when(first, l("node")).otherwise(m("node")).alias("v")).distinct()
        fresh = stored(pairs if tried is None else pairs.join(tried, ["u", "v"], "left_anti"), "pairs", files=files)
        linked = stored(_verify(fresh, texts, similarity), "links", files=files)
        before, labels = labels, components(linked) if labels is None else _joined(labels, linked)
        if before is not None:
            discard(before)
        tried = fresh if tried is None else tried.unionByName(fresh)
        if leaders:
            relabelled = left.drop("comp").join(labels, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label")
            after = stored(_open(relabelled), "buckets", files=files)
            discard(left)
            left = after
        done += [fresh, linked]
    discard(left, texts, *done)
    return labels if labels is not None else docs.sparkSession.createDataFrame([], "node binary, label binary")


def _joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels with the components that further edges connect made one."""
    if edges.isEmpty():
        return stored(labels, "labels", files=1)
    named = edges
    for c in ("u", "v"):
        named = named.join(labels.select(F.col("node").alias(c), F.col("label").alias("l")), c, "left").withColumn(c, F.coalesce("l", c)).drop("l")
    joined = components(named.filter("u != v").select("u", "v").distinct())
    known = labels.unionByName(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(labels, "node", "left_anti").withColumn("label", F.col("node")))
    out = stored(known.join(joined.select(F.col("node").alias("label"), F.col("label").alias("least")), "label", "left").select("node", F.coalesce("least", "label").alias("label")), "labels", files=1)
    discard(joined)
    return out


def _open(left: DataFrame) -> DataFrame:
    """Rows of the buckets that hold two components or more."""
    more = left.groupBy("bucket").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a != b").select("bucket")
    return left.join(more, "bucket")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that each node of the edges is connected to."""
    both = stored(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges", files=1)
    labels = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels", files=1)
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), F.col("label").alias("l")), "v").groupBy("u").agg(F.min("l").alias("l"))
        least = labels.join(near, labels["node"] == near["u"]).select("node", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = stored(least.join(jump, "label").select("node", "old", F.least("label", "further").alias("label")), "labels", files=1)
        discard(labels)
        labels = after.select("node", "label")
        labels._stored_at = after._stored_at
        if after.filter(F.col("old") != F.col("label")).isEmpty():
            discard(both)
            return labels


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, copy, node, class_id): a row for each row of docs; copy tells the text, node its folded words."""
    rest(docs.sparkSession)
    nodes = stored(nodes_of(docs, id_column, text), "nodes", files=docs.count() // TASK_NODES + 1)
    rest(docs.sparkSession)
    labels = links(docs, nodes, text, similarity)
    own = nodes.select("id", "copy", "node")
    least = own.groupBy("node").agg(F.min("id").alias("least"))
    # each table that a large group of copies or a large class joins is written first, so that both sides of the join can be split
    linked = stored(least.join(labels, "node"), "linked", files=1)
    of_class = stored(linked.groupBy("label").agg(F.min("least").alias("class_id")), "classes", files=1)
    by_node = linked.join(of_class, "label").select("node", "class_id")
    named = stored(least.join(by_node, "node", "left").select("node", F.coalesce("class_id", "least").alias("class_id")), "named", files=1)
    discard(linked, of_class, labels)
    return own.join(named, "node").select(F.col("id").alias(id_column), "copy", "node", "class_id")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs without all but one row of each class: the one with the least id, of equal ids the one with the least text hash."""
    found = near_duplicates(docs, id_column, text, similarity)
    # without an id there is no class_id either: such a class is told by its nodes, of which at least one row stays
    first = found.filter(F.col(id_column).eqNullSafe(F.col("class_id")))
    chosen = first.groupBy("class_id", F.when(F.col("class_id").isNull(), F.col("node")).alias("own")).agg(F.min("copy").alias("__copy")).select("__copy", F.struct(F.col("class_id").alias("id")).alias("__key"))
    # a struct, so that null ids are equal and one exchange by (copy, id) serves the join and the removal of repeated rows
    rows = docs.withColumns({"__copy": _copy(text), "__key": F.struct(F.col(id_column).alias("id"))})
    return rows.join(chosen, ["__copy", "__key"], "left_semi").dropDuplicates(["__copy", "__key"]).select(*docs.columns)


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    return few_files(near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "class_id"))
