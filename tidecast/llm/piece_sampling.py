"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice, and its lossless decoding.

The vocabulary of a SentencePiece model gives the lattice of a text: an edge for each piece found at each place. A piece of
merge rank r weighs (r + 10) ** -alpha; a character that no piece covers is an edge to its UTF-8 byte pieces. No piece holds a
space after another character or a line end, so the lattice falls apart into chunks (spaces and the characters up to the next
space); the forward sums of a chunk are found once per task and kept in a bounded store, the backward draws are made for each
occurrence, with random numbers that depend on the row key, the chunk's number in the text and the draw's number alone.
So a row's pieces are the same on any cluster, in any order and after any retry.

A space is written as the model's space mark, and one is put before the text, as the model does; a literal mark becomes bytes.
Decoding joins the pieces' bytes and takes that one space off: it returns every text as it was.

Cases: a null text has null pieces and decodes to null; an empty text has the pieces of the leading space; very long texts are
taken in parts of a batch, very long words one by one; repeated rows get equal pieces; null keys share one seed; other columns stay (a column named like the result is replaced); an empty table gives
an empty table. Piece ids that the vocabulary lacks are an error in decoding.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, in_arrow, mix, read

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE_MARK = "▁"
CHUNK = re.compile(r"\n| *[^ \n]+| +")
_B = U64(0x9E3779B97F4A7C55)
LONG = 32  # characters; longer chunks are drawn one by one, in logarithms
STORE_EDGES = 4_000_000  # then the store of chunks starts anew
BATCH_CHARS = 1 << 20
LATTICE_CELLS = 1 << 19  # (chunk, end place, edge length) at a time
_UNCOVERED = 1e-8


class Vocabulary:
    """Pieces, weights and a hash table of their prefixes; small and fixed by the model, so it is broadcast."""

    def __init__(self, pieces: list[str | None], ranks: list[float], byte_ids: list[int], alpha: float = 1.0):
        """pieces: text by id, with spaces for space marks; None for ids that stand for no text."""
        self.byte_ids, self.n = byte_ids, len(pieces)
        self.bytes = np.empty(self.n, object)
        for i, p in enumerate(pieces):
            self.bytes[i] = None if p is None else p.encode()
            if p is not None and (" " in p.lstrip(" ") or "\n" in p):
                raise ValueError(f"piece {i} crosses a chunk's end")
        for b, i in enumerate(byte_ids):
            self.bytes[i] = bytes([b])
        self.weight = np.array([(r + 10.0) ** -alpha for r in ranks])
        self.longest = max(len(p) for p in pieces if p)
        self.by_text = {p: i for i, p in enumerate(pieces) if p}
        entries: dict[int, int] = {}
        for p in self.by_text:
            for k in range(1, len(p) + 1):
                entries.setdefault(self._hash(p[:k]), -1)
        for p, i in self.by_text.items():
            entries[self._hash(p)] = i
        self.bits = max(16, (4 * len(entries)).bit_length())
        self.keys, self.ids = np.zeros(1 << self.bits, U64), np.full(1 << self.bits, -2, np.int32)  # -1: a prefix only
        for h, i in entries.items():
            at = self._slot(h)
            while self.ids[at] != -2:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.ids[at] = h, i

    @classmethod
    def load(cls, path: str = MODEL, alpha: float = 1.0) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        bytes_at = {int(m.id_to_piece(i)[3:5], 16): i for i in range(n) if m.is_byte(i)}
        if len(bytes_at) < 256:
            raise ValueError("the model has no byte pieces: decoding would lose characters")
        plain = [not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or m.is_byte(i)) for i in range(n)]
        return cls([m.id_to_piece(i).replace(SPACE_MARK, " ") if plain[i] else None for i in range(n)], [max(0.0, -m.get_score(i)) if plain[i] else 0.0 for i in range(n)], [bytes_at[b] for b in range(256)], alpha)

    @staticmethod
    def _hash(text: str) -> int:
        h, power = 0, 1
        for c in text:
            h, power = (h + ord(c) * power) % (1 << 64), power * int(_B) % (1 << 64)
        return (h + len(text) * 0x2545F4914F6CDD1D) % (1 << 64)

    def _slot(self, h: int) -> int:
        return (h * 0xD6E8FEB86659FD93 % (1 << 64)) >> (64 - self.bits)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Id of each hash; -1 for a mere prefix, -2 for neither."""
        top = (1 << self.bits) - 1
        at = (h * U64(0xD6E8FEB86659FD93) >> U64(64 - self.bits)).astype(np.int64)
        ids = self.ids[at]
        odd = np.flatnonzero((ids != -2) & (self.keys[at] != h))
        while len(odd):
            at[odd] = (at[odd] + 1) & top
            ids[odd] = self.ids[at[odd]]
            odd = odd[(ids[odd] != -2) & (self.keys[at[odd]] != h[odd])]
        return ids

    def expand(self, ids: np.ndarray) -> np.ndarray:
        """ids with each number beyond the vocabulary, n plus a code point, as that character's byte pieces."""
        if not len(ids) or ids.max() < self.n:
            return ids
        out: list[int] = []
        for i in ids.tolist():
            if i < self.n:
                out.append(i)
            else:
                out.extend(self.byte_ids[b] for b in chr(i - self.n).encode())
        return np.array(out, np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.bytes[ids].tolist())[1:]


class _Numbers(dict):
    """Numbers for chunks in the order they come; fresh: those not yet in the store."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        self.fresh.append(chunk)
        return n


class Sampler:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._clear()

    def _clear(self) -> None:
        self.numbers = _Numbers()
        self.size = np.zeros(0, np.int32)  # characters by chunk; -1: long
        self.base = np.zeros(0, np.int64)  # first node by chunk; node: one end place of an edge
        self.first = np.zeros(1, np.int64)  # first edge by node, and the number of edges
        self.cum, self.length, self.piece = np.zeros(0), np.zeros(0, np.int8), np.zeros(0, np.int32)  # by edge

    def encode(self, texts: list[str], seeds: np.ndarray) -> list[np.ndarray]:
        if len(self.cum) > STORE_EDGES:
            self._clear()
        numbers = self.numbers
        chunks = [CHUNK.findall(" " + t) for t in texts]
        of = [np.fromiter(map(numbers.__getitem__, c), np.int64, len(c)) for c in chunks]
        if numbers.fresh:
            self._add(numbers.fresh)
            numbers.fresh = []
        per = np.array([len(x) for x in of])
        number = np.concatenate(of) if of else np.zeros(0, np.int64)
        starts = np.cumsum(per) - per
        nth = np.arange(len(number)) - np.repeat(starts, per)
        state = mix(np.repeat(seeds, per) + nth.astype(U64) * U64(0xA0761D6478BD642F))
        long: dict[int, np.ndarray] = {}
        for k in np.flatnonzero(self.size[number] < 0).tolist():
            d = int(np.searchsorted(starts + per, k, "right"))
            long[k] = self._draw_long(chunks[d][k - int(starts[d])], int(state[k]))
        count = np.zeros(len(number), np.int32)
        at = np.flatnonzero(self.size[number] > 0)
        node0, end = self.base[number[at]] - 1, self.size[number[at]].astype(np.int64)
        drawn, step = [], 0
        while len(at):
            u = (mix(state[at] + U64((step + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> U64(11)).astype(np.float64) * 2.0**-53
            edge = self.first[node0 + end]
            low = np.flatnonzero(self.cum[edge] <= u)
            while len(low):
                edge[low] += 1
                low = low[self.cum[edge[low]] <= u[low]]
            drawn.append((at, self.piece[edge]))
            count[at] += 1
            end = end - self.length[edge]
            more = end > 0
            at, node0, end = at[more], node0[more], end[more]
            step += 1
        for k, ids in long.items():
            count[k] = len(ids)
        after = np.cumsum(count)
        out = np.empty(int(after[-1]) if len(after) else 0, np.int32)
        for t, (k, ids) in enumerate(drawn):
            out[after[k] - 1 - t] = ids
        for k, ids in long.items():
            out[after[k] - count[k] : after[k]] = ids
        ends = after[starts + per - 1] if len(per) else []
        return [self.v.expand(x) for x in np.split(out, ends[:-1])] if len(per) else []

    def _add(self, fresh: list[str]) -> None:
        sizes = np.array([len(c) if len(c) <= LONG else -1 for c in fresh], np.int32)
        nodes = np.maximum(sizes, 0).astype(np.int64)
        base = len(self.first) - 1 + np.cumsum(nodes) - nodes
        first_edges = np.zeros(int(nodes.sum()), np.int64)
        parts = []
        for size in np.unique(sizes[sizes > 0]).tolist():
            which = np.flatnonzero(sizes == size)
            step = max(1, LATTICE_CELLS // (size * min(size, self.v.longest)))
            for k in range(0, len(which), step):
                some = which[k : k + step]
                cum, length, piece, per_node = self._lattices(np.frombuffer("".join(fresh[i] for i in some).encode("utf-32-le"), np.uint32).reshape(len(some), size))
                at = (base[some, None] - (len(self.first) - 1) + np.arange(size)).ravel()
                parts.append((at, per_node, cum, length, piece))
        if parts:
            # edges lie in the order of parts, not of nodes: each node keeps its first edge only, the last of its edges has sum 2
            offset = len(self.cum)
            for at, per_node, cum, _, _ in parts:
                first_edges[at] = offset + np.cumsum(per_node) - per_node
                offset += len(cum)
            self.cum = np.concatenate([self.cum, *(p[2] for p in parts)])
            self.length = np.concatenate([self.length, *(p[3] for p in parts)])
            self.piece = np.concatenate([self.piece, *(p[4] for p in parts)])
        self.first = np.concatenate([self.first[:-1], first_edges, [len(self.cum)]])
        self.size, self.base = np.concatenate([self.size, sizes]), np.concatenate([self.base, base])

    def _lattices(self, c: np.ndarray):
        """Edges of chunks of one size, by (chunk, end place, edge length): their running share of the forward sum at that place."""
        n, size = c.shape
        top = min(size, self.v.longest)
        ids = np.full((n, size, top), -2, np.int32)  # by end place and length - 1
        h, power = np.zeros((n, size), U64), U64(1)
        for k in range(1, top + 1):
            h = h[:, : size - k + 1] + c[:, k - 1 :].astype(U64) * power
            with np.errstate(over="ignore"):
                power = power * _B
                ids[:, k - 1 :, k - 1] = self.v.find((h + U64(k * 0x2545F4914F6CDD1D & (1 << 64) - 1)).ravel()).reshape(h.shape)
        bare = ids[:, :, 0] < 0
        w = np.where(ids >= 0, self.v.weight[np.maximum(ids, 0)], 0.0)
        w[:, :, 0][bare] = _UNCOVERED
        ids[:, :, 0][bare] = self.v.n + c.astype(np.int32)[bare]
        forward = np.zeros((n, size + 1))
        forward[:, 0] = 1.0
        for e in range(1, size + 1):
            m = min(e, top)
            w[:, e - 1, :m] *= forward[:, e - m : e][:, ::-1]
            forward[:, e] = w[:, e - 1, :m].sum(axis=1)
        live = w > 0
        share = np.cumsum(w, axis=2) / forward[:, 1:, None]
        last = top - 1 - np.argmax(live[:, :, ::-1], axis=2)
        np.put_along_axis(share, last[:, :, None], 2.0, axis=2)
        lengths = np.broadcast_to(np.arange(1, top + 1, dtype=np.int8), live.shape)
        return share[live], lengths[live], ids[live], live.sum(axis=2).ravel()

    def _draw_long(self, chunk: str, state: int) -> np.ndarray:
        v, n = self.v, len(chunk)
        log = np.full(n + 1, -np.inf)
        log[0] = 0.0
        edges: list[list] = [[] for _ in range(n + 1)]
        for e in range(1, n + 1):
            for k in range(1, min(e, v.longest) + 1):
                i = v.by_text.get(chunk[e - k : e])
                if i is not None:
                    edges[e].append((k, i, log[e - k] + np.log(v.weight[i])))
                elif k == 1:
                    edges[e].append((1, v.n + ord(chunk[e - 1]), log[e - 1] + np.log(_UNCOVERED)))
            values = [x[2] for x in edges[e]]
            most = max(values)
            log[e] = most + np.log(sum(np.exp(x - most) for x in values))
        out, e = [], n
        u = (mix(U64(state) + np.arange(1, n + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)) >> U64(11)).astype(np.float64) * 2.0**-53
        while e:
            left = u[len(out)]
            for k, i, value in edges[e]:
                left -= np.exp(value - log[e])
                if left < 0:
                    break
            out.append(i)
            e -= k
        return np.array(out[::-1], np.int32)


def encode(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text", out: str = "pieces", seed: int = 0) -> DataFrame:
    """docs with the sampled piece ids of each text, array<int>; another seed draws other segmentations."""
    docs = docs.drop(out) if out not in (key, text) else docs
    handle = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    at, names = docs.columns.index(text), schema.names

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(handle.value)
        for batch in batches:
            texts, seeds = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_numpy().view(np.uint64)
            k = 0
            while k < len(texts):
                size, stop = 0, k
                while stop < len(texts) and (size < BATCH_CHARS or stop == k):
                    size, stop = size + len(texts[stop] or ""), stop + 1
                found = sampler.encode([t or "" for t in texts[k:stop]], seeds[k:stop])
                null = np.array([t is None for t in texts[k:stop]])
                sizes = np.array([0 if x else len(f) for x, f in zip(null, found, strict=True)])
                values = [f for x, f in zip(null, found, strict=True) if not x]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(values) if values else [], pa.int32()), mask=pa.array(null))
                yield pa.RecordBatch.from_arrays([*batch.slice(k, stop - k).columns[:-1], lists], names)
                k = stop

    return in_arrow(docs.withColumn("__seed", F.xxhash64(F.lit(seed), F.col(key))), apply, schema)


def decode(encoded: DataFrame, vocabulary: Vocabulary, pieces: str = "pieces", out: str = "decoded") -> DataFrame:
    """encoded with the text of each row's piece ids."""
    encoded = encoded.drop(out) if out != pieces else encoded
    handle = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    schema = T.StructType([*encoded.schema.fields, T.StructField(out, T.StringType())])
    at, names = encoded.columns.index(pieces), schema.names

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = handle.value
        for batch in batches:
            column = batch.column(at)
            ids, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            texts = [None if null else v.decode(ids[a:b]) for null, a, b in zip(column.is_null().to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], names)

    return in_arrow(encoded, apply, schema)


def op3_piece_sampling(spark, sf_dir: str, model: str = MODEL) -> DataFrame:
    v = Vocabulary.load(model)
    encoded = encode(read(spark, sf_dir, "documents").select("doc_id", "text"), v)
    return decode(encoded, v).select(
        "doc_id", F.size(F.coalesce("pieces", F.array().cast("array<int>"))).cast("long").alias("n_pieces"), F.xxhash64("pieces").alias("pieces_hash"), F.equal_null("text", "decoded").alias("lossless")
    )
