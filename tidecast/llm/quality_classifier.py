"""Quality classifier from weak labels.

1. Overlapping heuristic labellers vote good, bad or nothing on every document. The votes of all documents are counted by
   pattern (at most 3 ** labellers patterns) in one aggregation.
2. Expectation-maximisation over these counts estimates the share of good documents and each labeller's votes for good and
   for bad ones; every pattern, so every document, has a posterior.
3. A linear scorer on hashed features (byte trigrams, and bins of a few ratios) is fitted to the posteriors of a sample by hash
   of about ``train_rows`` documents (a documented bound: a classifier may be fitted on a sample), then scores all documents.

Cases: a null text is an empty one; texts without words get votes and a score like any other; very long texts are judged whole;
repeated rows and copies get equal scores, and copies count once in the sample (but each in the counts of votes);
null ids are kept; a column named like a result is replaced; without documents there is nothing to fit and the result is empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_BY_ALNUM, WORD_BY_SPACE, as_bytes, in_arrow, read, word_bounds
from .quality_rules import SYMBOLS, Text

GOOD, BAD, NONE = 1, 0, 2
TRAIN_ROWS = 4096
DIMENSIONS = 1 << 14


@dataclass(frozen=True)
class Labeller:
    name: str
    ratio: Callable[[Text], float]
    good: tuple[float, float]  # votes good within these bounds
    bad: tuple[float, float]  # else bad within these, else nothing

    def vote(self, r: float) -> int:
        return GOOD if self.good[0] <= r <= self.good[1] else BAD if self.bad[0] <= r <= self.bad[1] else NONE


def _words(t: Text) -> int:
    return max(1, t.n_words)


def _ends(t: Text) -> tuple[np.ndarray, np.ndarray]:
    """Last byte of each word and the byte before it, a space where it has one byte."""
    if "ends" not in t.__dict__:
        starts, ends = word_bounds(t.data, WORD_BY_SPACE)
        b = np.frombuffer(b" " + t.data, np.uint8)
        t.__dict__["ends"] = b[ends], np.where(ends - starts > 1, b[ends - 1], 32)
    return t.__dict__["ends"]


_IS_SYMBOL, _IS_MARK = (np.array([b in chars for b in range(256)]) for chars in (SYMBOLS, b".,?:;"))


def _marked(t: Text) -> float:
    """Share of words that end in a symbol."""
    return int(_IS_SYMBOL[_ends(t)[0]].sum()) / _words(t)


def _exclaimed(t: Text) -> float:
    return t.data.count(b"!") / _words(t)


def _distinct(t: Text) -> float:
    return len(set(t.words)) / _words(t) ** 0.9


def _repeated(t: Text) -> float:
    """Of short texts, a repeated line says little."""
    return t.n_repeat_words / max(50, t.n_words)


def _duplicated(t: Text) -> float:
    return t.n_dup_lines / max(8, len(t.lines))


def _worst(t: Text) -> float:
    """The largest of several shares of noise."""
    return max(t.n_symbols / _words(t), _repeated(t), t.n_shouted / _words(t), _duplicated(t))


def _paused(t: Text) -> float:
    """Share of words that end in one of the marks of prose, without a mark repeated."""
    if _exclaimed(t) > 0.2 or _marked(t) > 0.2:
        return 0.0
    last, before = _ends(t)
    return int((_IS_MARK[last] & WORD_BY_ALNUM[before]).sum()) / _words(t)


_INF = float("inf")
_NEVER = (1.0, 0.0)
#: A kind of noise is seen by two labellers or more, which say nothing of other texts; two look for plain prose.
LABELLERS = (
    Labeller("symbols", lambda t: t.n_symbols / _words(t), _NEVER, (0.1, _INF)),
    Labeller("marked_words", _marked, _NEVER, (0.2, 1)),
    Labeller("repeats", _repeated, _NEVER, (0.5, 1)),
    Labeller("variety", _distinct, _NEVER, (0, 0.25)),
    Labeller("duplicate_lines", _duplicated, _NEVER, (0.34, 1)),
    Labeller("shouting", lambda t: t.n_shouted / _words(t), _NEVER, (0.4, 1)),
    Labeller("exclamations", _exclaimed, _NEVER, (0.2, _INF)),
    Labeller("little_noise", _worst, (0, 0.1), (0.5, _INF)),
    Labeller("prose_marks", _paused, (0.03, 0.5), (0, 0.001)),
)


def ratios(t: Text, labellers: Sequence[Labeller] = LABELLERS) -> list[float]:
    return [labeller.ratio(t) for labeller in labellers]


def votes(found: Sequence[float], labellers: Sequence[Labeller] = LABELLERS) -> int:
    """The votes on a text of these ratios as one number in base 3."""
    n = 0
    for labeller, r in zip(labellers, found, strict=True):
        n = 3 * n + labeller.vote(r)
    return n


def _digits(patterns: np.ndarray, k: int) -> np.ndarray:
    return np.stack([patterns // 3 ** (k - 1 - i) % 3 for i in range(k)], axis=1)


@dataclass
class LabelModel:
    """prior: share of good; table[labeller, class, vote]: probability of a vote in a class, class 1 is good."""

    prior: float
    table: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good for each pattern."""
        v = _digits(np.asarray(patterns, np.int64), len(self.table))
        logs = np.log(self.table)[np.arange(len(self.table))[None, :], :, v].sum(axis=1)  # by pattern and class
        z = logs[:, 1] - logs[:, 0] + np.log(self.prior) - np.log(1 - self.prior)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def accuracy(self) -> np.ndarray:
        """Share of right votes among each labeller's votes for good or bad."""
        p = np.array([1 - self.prior, self.prior])
        right = p[0] * self.table[:, 0, BAD] + p[1] * self.table[:, 1, GOOD]
        return right / (p @ self.table[:, :, :2].sum(axis=2).T)


def fit_labels(patterns: np.ndarray, counts: np.ndarray, k: int, steps: int = 200) -> LabelModel:
    """Expectation-maximisation from the labellers' majority; add-one smoothing keeps every vote possible."""
    v = _digits(np.asarray(patterns, np.int64), k)
    good = ((v == GOOD).sum(axis=1) + 1) / ((v != NONE).sum(axis=1) + 2)
    model = None
    for _ in range(steps):
        q = np.stack([counts * (1 - good), counts * good])
        table = np.stack([np.stack([(q * (v[:, i] == x)).sum(axis=1) for x in range(3)], axis=1) for i in range(k)]) + 1.0
        model = LabelModel(float((q[1].sum() + 1) / (counts.sum() + 2)), table / table.sum(axis=2, keepdims=True))
        before, good = good, model.posterior(patterns)
        if np.abs(good - before).max() < 1e-9:
            break
    return model


def features(t: Text, found: Sequence[float], dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Places and values: roots of the shares of hashed byte trigrams, and a place for the bin of each labeller's ratio."""
    b = np.frombuffer(t.data, np.uint8).astype(np.uint32)
    h = (b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F) >> np.uint32(32 - (dimensions.bit_length() - 1))
    n = np.bincount(h, minlength=dimensions)
    at = np.flatnonzero(n)
    value = np.sqrt(n[at] / max(1, len(h)))
    bins = [(i * 101 + min(9, int(10 * min(1.0, r / 2))) * 7919 + 13) % dimensions for i, r in enumerate(found)]
    return np.concatenate([at, bins]), np.concatenate([value, np.full(len(bins), 0.3)])


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]], dimensions: int = DIMENSIONS, steps: int = 150, penalty: float = 1e-4) -> np.ndarray:
    """Weights, the last of them the bias, of a logistic fit to soft labels by accelerated gradient steps."""
    at = np.concatenate([r[0] for r in rows])
    value = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    y = np.array([r[2] for r in rows])
    w = ahead = np.zeros(dimensions + 1)
    for step in range(steps):
        z = np.bincount(row, ahead[at] * value, len(rows)) + ahead[-1]
        error = (1 / (1 + np.exp(-z)) - y) / len(rows)
        gradient = np.append(np.bincount(at, error[row] * value, dimensions), error.sum()) + penalty * ahead
        after = ahead - 1.2 * gradient  # the rows' squared norm is below 3, so is a quarter of it below 1 / 1.2
        ahead = after + step / (step + 3) * (after - w)
        w = after
    return w


def classify(docs: DataFrame, text: str = "text", labellers: Sequence[Labeller] = LABELLERS, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """docs with votes (base 3), posterior, score (0 to 1) and good (score of one half or more)."""
    docs = docs.drop(*[c for c in ("votes", "posterior", "score", "good") if c != text])
    texts = docs.select(F.col(text).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            for x in as_bytes(batch.column(0)):
                v = votes(ratios(Text(x), labellers), labellers)
                seen[v] = seen.get(v, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["pattern", "n"])

    schema = T.StructType([*docs.schema.fields, T.StructField("votes", T.LongType()), T.StructField("posterior", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("good", T.BooleanType())])
    patterns = sorted(tuple(r) for r in in_arrow(texts, count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect())  # at most 3 ** labellers
    if not patterns:
        return docs.sparkSession.createDataFrame([], schema)
    counts = np.array([p[1] for p in patterns], float)
    model = fit_labels(np.array([p[0] for p in patterns]), counts, len(labellers))
    size = 1 << 40
    sample = texts.filter(F.pmod(F.xxhash64(F.lit(8), "text"), F.lit(size)) < F.lit(min(size, max(1, int(size * train_rows / counts.sum())))))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in as_bytes(batch.column(0)):
                t = Text(x)
                found = ratios(t, labellers)
                at, value = features(t, found)
                rows.append((votes(found, labellers), at.astype(np.int32).tobytes(), value.astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["votes", "place", "value"])

    # about train_rows rows; copies count once, so a large group of copies does not swell the sample
    rows = sorted((r.votes, bytes(r.place), bytes(r.value)) for r in in_arrow(sample.distinct(), featured, "votes long, place binary, value binary").collect())
    good = model.posterior(np.array([r[0] for r in rows])) if rows else []
    weights = fit_scorer([(np.frombuffer(a, np.int32), np.frombuffer(b, np.float32).astype(float), float(y)) for (_, a, b), y in zip(rows, good, strict=True)]) if rows else np.append(np.zeros(DIMENSIONS), np.log(model.prior / (1 - model.prior)))
    handle = docs.sparkSession.sparkContext.broadcast((model, weights))
    at_text, names = docs.columns.index(text), schema.names

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, w = handle.value
        for batch in batches:
            v, z = [], []
            for x in as_bytes(batch.column(at_text)):
                t = Text(x)
                found = ratios(t, labellers)
                v.append(votes(found, labellers))
                at, value = features(t, found)
                z.append(float(w[at] @ value + w[-1]))
            s = 1 / (1 + np.exp(-np.array(z)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(v, pa.int64()), pa.array(labels.posterior(np.array(v, np.int64)) if v else [], pa.float64()), pa.array(s, pa.float64()), pa.array(s >= 0.5, pa.bool_())], names)

    return in_arrow(docs, score, schema)


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    found = classify(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.round("posterior", 6).alias("posterior"), F.round("score", 6).alias("score"), F.col("good").alias("kept"))
