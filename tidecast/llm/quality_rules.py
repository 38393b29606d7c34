"""Quality rules as a short-circuit cascade.

Each rule looks at figures of one text and may reject it. On a sample by hash of about ``sample_rows`` different texts the cost
of each figure (CPU seconds) and the rules that reject each text are measured. The cascade is then built step by step: next
comes the rule that rejects most of the sample's remaining texts per second of the figures that no rule before it has asked for.
The first rejection ends the cascade; figures asked for besides are found after it, from what it left. The order changes the
work only, never the verdict: a text is kept when no rule rejects it.

Cases: a null text has no words; a text of no words fails ``min_words``; very long texts are judged whole; copies of a text count
once in the sample; repeated rows, null ids and extra columns are left as they are, but a column named like a result is replaced;
an empty table gives an empty table (rules then keep the order given).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_BY_SPACE, as_bytes, in_arrow, read, shingles, word_hashes

SYMBOLS = b"#*$%&|<>"
WINDOW = 3


class Text:
    """Figures of one text, each found when first asked for."""

    def __init__(self, data: bytes):
        self.data = data

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(b"".join(self.words).decode("utf-8", "replace"))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.data) - len(self.data.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.data.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        h, _, _ = word_hashes(self.data, WORD_BY_SPACE)
        if len(h) < WINDOW + 1:
            return 0
        _, which, n = np.unique(shingles(h, WINDOW), return_inverse=True, return_counts=True)
        twice = n[which] > 1
        held = np.zeros(len(h), bool)
        for k in range(WINDOW):
            held[k : k + len(twice)] |= twice
        return int(held.sum())

    @cached_property
    def n_shouted(self) -> int:
        """Words of at least two bytes with a letter A-Z and none of a-z."""
        return sum(len(w) > 1 and w.isupper() for w in self.words)


@dataclass(frozen=True)
class Rule:
    """figures: what rejects() asks a Text for, whatever it needs first in front."""

    name: str
    rejects: Callable[[Text], bool]
    figures: tuple[str, ...] = ("words",)


def _too_few(t: Text) -> bool:
    return t.n_words < 50


def _repeats(t: Text) -> bool:
    return 100 * t.n_repeat_words > 50 * t.n_words


BASE_RULES = (Rule("min_words", _too_few), Rule("repeated_windows", _repeats, ("words", "n_repeat_words")))
RULES = (
    *BASE_RULES,
    Rule("symbols", lambda t: 100 * t.n_symbols > 10 * t.n_words, ("words", "n_symbols")),
    Rule("duplicate_lines", lambda t: t.n_dup_lines >= 5 and 100 * t.n_dup_lines > 30 * len(t.lines), ("lines", "n_dup_lines")),
    Rule("shouting", lambda t: 100 * t.n_shouted > 40 * t.n_words, ("words", "n_shouted")),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 14 * t.n_words, ("words", "word_chars")),
)


def rule_statistics(docs: DataFrame, rules: Sequence[Rule], text: str = "text", sample_rows: int = 512) -> tuple[dict[str, float], dict[int, int]]:
    """CPU seconds of each figure, and how many texts of the sample each set of rules rejects (bit i: rules[i])."""
    figures = list(dict.fromkeys(f for r in rules for f in r.figures))
    n = docs.count()
    if not n:
        return dict.fromkeys(figures, 0.0), {}
    size = 1 << 40
    sample = docs.select(F.col(text).cast("string").alias("text")).filter(F.pmod(F.xxhash64("text"), F.lit(size)) < F.lit(min(size, max(1, size * sample_rows // n)))).distinct()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, masks = dict.fromkeys(figures, 0.0), {}
        for batch in batches:
            for x in as_bytes(batch.column(0)):
                t = Text(x)
                for f in figures:
                    began = time.process_time()
                    getattr(t, f)
                    cost[f] += time.process_time() - began
                mask = sum(bool(r.rejects(t)) << i for i, r in enumerate(rules))
                masks[mask] = masks.get(mask, 0) + 1
        rows = [(f, None, c) for f, c in cost.items()] + [(None, m, float(k)) for m, k in masks.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], ["figure", "mask", "n"])

    found = in_arrow(sample, measure, "figure string, mask long, n double").groupBy("figure", "mask").agg(F.sum("n").alias("n")).collect()  # figures and sets of rules
    costs = dict.fromkeys(figures, 0.0) | {r.figure: r.n for r in found if r.figure}
    return costs, {r.mask: int(r.n) for r in found if r.figure is None}


def cascade_order(rules: Sequence[Rule], costs: dict[str, float], rejected: dict[int, int]) -> list[Rule]:
    """Each time the rule with most rejections, among the texts that are left, per second that it adds; ties stay in the order given."""
    left, found, order = dict(enumerate(rules)), set(), []
    while left:
        adds = {i: sum(costs.get(f, 0.0) for f in set(r.figures) - found) for i, r in left.items()}
        gone = {i: sum(n for mask, n in rejected.items() if mask >> i & 1) for i in left}
        best = max(left, key=lambda i: (gone[i] / max(adds[i], 1e-9), -i))
        rejected = {mask: n for mask, n in rejected.items() if not mask >> best & 1}
        found |= set(left[best].figures)
        order.append(left.pop(best))
    return order


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", figures: bool = False, sample_rows: int = 512) -> DataFrame:
    """docs with kept; with figures also the columns of FIGURES and base_failed. A column of docs with such a name is replaced."""
    added = [*(T.StructField(c, T.LongType()) for c in FIGURES), T.StructField("base_failed", T.BooleanType())] * figures + [T.StructField("kept", T.BooleanType())]
    docs = docs.drop(*[f.name for f in added if f.name != text])
    order = cascade_order(rules, *rule_statistics(docs, rules, text, sample_rows))
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, *added])
    names = schema.names

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, found, failed = [], [], []
            for x in as_bytes(batch.column(at)):
                t = Text(x)
                kept.append(not any(rule.rejects(t) for rule in order))
                if figures:
                    found.append([getattr(t, c) for c in FIGURES])
                    failed.append(_too_few(t) or _repeats(t))
            columns = [pa.array(np.array(found, np.int64).reshape(-1, len(FIGURES))[:, i]) for i in range(len(FIGURES))] + [pa.array(failed, pa.bool_())] if figures else []
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns, pa.array(kept, pa.bool_())], names)

    return in_arrow(docs, apply, schema)


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    judged = judge(read(spark, sf_dir, "documents").select("doc_id", "text"), figures=True)
    return judged.select("doc_id", *FIGURES, "base_failed", "kept")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), f AS (
  SELECT doc_id, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         len(list_filter(w, lambda x: len(x) > 1 AND regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_shouted
  FROM d
), pos AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2])) AS g FROM f WHERE len(w) >= 3
), twice AS (
  SELECT doc_id, p FROM pos QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), rep AS (
  SELECT doc_id, count(DISTINCT p + k) AS n FROM twice, range(3) t(k) GROUP BY doc_id
), s AS (
  SELECT f.doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(lines) AS n_lines, n_shouted
  FROM f LEFT JOIN rep ON f.doc_id = rep.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 10 * n_words OR (n_dup_lines >= 5 AND 100 * n_dup_lines > 30 * n_lines)
            OR 100 * n_shouted > 40 * n_words OR NOT (2 * n_words <= word_chars AND word_chars <= 14 * n_words)) AS kept
FROM s
"""
