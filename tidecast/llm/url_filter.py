"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest; DataFrame operations only.

Features of a URL: length, host length, host labels, path depth, digit ratio, character entropy, hyphens, parameters, and the
smoothed log-odds of blocked among labelled URLs of the same host suffix, path suffix and first path segment. In training a URL
gets the log-odds of the other folds (``FOLDS``, by hash), so its own label is not among its features. The trees are
fitted on at most ``train_rows`` labelled URLs (the first by hash): each level of a tree is one aggregation of gradients by
(node, feature, bin) in whole numbers, so sums do not depend on the order of rows, and only these histograms, of a size
fixed by the parameters, come to the driver. Scoring is one CASE expression over all rows.

Cases: a null URL or one without ``://`` has an empty host and path and no rule, and the model judges it by its features;
without any labelled URL the model allows; very long URLs are taken whole; repeated rows are judged alike (ties included: all
sums are of whole numbers); null ids are kept; an empty table gives an empty table; a column of
pages that bears the name of a result is replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read, stored
from .license_scan import LOWER, UPPER

# The rules of the contract.
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

_PARTS = r"://([^/?#]*)([^?#]*)"
STATISTICS = ("host_suffix", "path_suffix", "first_segment")
FEATURES = ("length", "host_length", "labels", "depth", "digits", "entropy", "hyphens", "parameters", *STATISTICS)
FOLDS = 5
_UNIT = 1_000_000  # gradients are summed in millionths


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    return ((host == rule[1]) | F.endswith(host, F.lit("." + rule[1]))) & F.startswith(path, F.lit(rule[2]))


def with_rule(pages: DataFrame, url: str, rules) -> DataFrame:
    """pages with host, path, rule (the longest that fits, else null) and rule_verdict."""
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    parts = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    pick = lambda of: F.coalesce(*[F.when(fits(F.col("host"), F.col("path"), r), F.lit(of(r))) for r in longest]) if longest else F.lit(None).cast("string")
    return parts.withColumn("rule", pick(lambda r: r[1] + r[2])).withColumn("rule_verdict", pick(lambda r: r[0]))


def _entropy(text: Column) -> Column:
    size = F.length(text)
    share = lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size
    terms = F.transform(F.array_distinct(F.split(text, "")), lambda c: -share(c) * F.log2(share(c)))
    return F.when(size > 0, F.round(F.aggregate(F.array_sort(F.filter(terms, lambda x: ~F.isnan(x))), F.lit(0.0), lambda a, x: a + x), 6)).otherwise(0.0)


def lexical(urls: DataFrame, url: str) -> DataFrame:
    """urls with __ columns: the plain features and the keys of the suffix statistics."""
    u = F.coalesce(F.col(url), F.lit(""))
    host, path = host_of(u), path_of(u)
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    plain = {
        "length": F.length(u), "host_length": F.length(host), "labels": F.size(F.split(host, r"\.")), "depth": F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))),
        "digits": F.round(F.length(F.regexp_replace(u, "[^0-9]", "")) / F.greatest(F.length(u), F.lit(1)), 6), "entropy": _entropy(u),
        "hyphens": F.length(u) - F.length(F.replace(u, F.lit("-"), F.lit(""))), "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
    }
    keys = {"host_suffix": F.regexp_extract(host, r"([^.]*)$", 1), "path_suffix": F.regexp_extract(path, r"(\.[A-Za-z0-9]+|/)$", 1), "first_segment": F.regexp_extract(path, r"^/([^/]*)", 1)}
    return urls.withColumns({f"__{k}": v.cast("double") for k, v in plain.items()} | {f"__{k}": v for k, v in keys.items()})


@dataclass
class UrlModel:
    """Trees as nested (feature, cut, left, right) or leaf values; statistics as (statistic, key, log_odds) rows."""

    prior: float = -1.0
    trees: list = field(default_factory=list)
    statistics: DataFrame | None = None

    def score(self) -> Column:
        """Log-odds of blocked, from the feature columns that featured() adds."""
        return sum((_tree(t) for t in self.trees), F.lit(self.prior))

    def featured(self, urls: DataFrame, url: str) -> DataFrame:
        return _with_odds(lexical(urls, url), self.statistics)


def _with_odds(found: DataFrame, statistics: DataFrame | None, *also: str) -> DataFrame:
    """found with the log-odds of its keys; also: further columns that both have."""
    for k in STATISTICS:
        if statistics is None:
            found = found.withColumn(f"__{k}", F.lit(0.0))
            continue
        odds = statistics.filter(F.col("statistic") == k).select(F.col("key").alias(f"__{k}"), F.col("log_odds").alias("__odds"), *also)
        # at most train_rows keys of three kinds
        found = found.join(F.broadcast(odds), [f"__{k}", *also], "left").withColumn(f"__{k}", F.coalesce("__odds", F.lit(0.0))).drop("__odds")
    return found


def _tree(node) -> Column:
    if not isinstance(node, tuple):
        return F.lit(float(node))
    k, cut, left, right = node
    return F.when(F.col(f"__{FEATURES[k]}") > cut, _tree(right)).otherwise(_tree(left))


def fit(labelled: DataFrame, url: str = "url", blocked: str = "blocked", trees: int = 12, depth: int = 2, bins: int = 16, rate: float = 0.5, train_rows: int = 20_000) -> UrlModel:
    """labelled: url and blocked (0 or 1)."""
    rows = labelled.filter(F.col(blocked).isNotNull()).select(F.col(url).alias("url"), F.col(blocked).cast("int").alias("y"))
    train = stored(lexical(rows.orderBy(F.xxhash64("url"), "url", "y").limit(train_rows), "url"), "urls")
    n, ones = train.agg(F.count("*"), F.sum("y")).first()
    if not n:
        return UrlModel()
    train = train.withColumn("__fold", F.pmod(F.xxhash64(F.lit(9), "url"), F.lit(FOLDS)))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("statistic"), F.col(f"__{k}").alias("key")) for k in STATISTICS]))
    by_fold = stored(train.select(kinds.alias("s"), "y", "__fold").groupBy("s.statistic", "s.key", "__fold").agg(F.sum("y").alias("a"), F.count("*").alias("n")), "url-counts", files=1)
    share = (ones + 1) / (n + 2)
    prior = math.log(share / (1 - share))
    log_odds = lambda a, n: F.round(F.log((a + 2 * share) / (n - a + 2 * (1 - share))) - prior, 6).alias("log_odds")
    whole = by_fold.groupBy("statistic", "key").agg(F.sum("a").alias("all_a"), F.sum("n").alias("all_n"))
    model = UrlModel(round(prior, 6), [], stored(whole.select("statistic", "key", log_odds(F.col("all_a"), F.col("all_n"))), "url-suffixes", files=1))
    others = by_fold.join(whole, ["statistic", "key"]).select("statistic", "key", "__fold", log_odds(F.col("all_a") - F.col("a"), F.col("all_n") - F.col("n")))
    x = _with_odds(train, others, "__fold").select("y", *[f"__{k}" for k in FEATURES])
    x = stored(x, "url-features")
    cuts_at = [i / bins for i in range(1, bins)]
    quantiles = x.agg(*[F.expr(f"percentile(`__{k}`, array({','.join(map(str, cuts_at))}))").alias(k) for k in FEATURES]).first()
    cuts = [sorted(set(quantiles[k])) for k in FEATURES]
    bin_of = [sum(((F.col(f"__{k}") > c).cast("int") for c in cuts[i]), F.lit(0)) for i, k in enumerate(FEATURES)]
    for _ in range(trees):
        p = 1 / (1 + F.exp(-model.score()))
        g, h = F.round((F.col("y") - p) * _UNIT).cast("long"), F.round(p * (1 - p) * _UNIT).cast("long")
        splits: dict[tuple, tuple] = {}  # node, as the turns taken to it: (feature, cut)
        leaves: dict[tuple, float] = {(): 0.0}
        for level in range(depth):
            node = _node(splits, (), level)
            sums = x.select(node.alias("node"), g.alias("g"), h.alias("h"), F.posexplode(F.array(*bin_of)).alias("feature", "bin")).groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
            by: dict = {}
            for r in sums.collect():  # nodes x features x bins
                by.setdefault(r.node, {}).setdefault(r.feature, {})[r.bin] = (r.g, r.h)
            for turns in [t for t in leaves if len(t) == level]:
                best = _best(by.get("".join(map(str, turns)), {}), cuts)
                if best:
                    k, cut, (gl, hl), (gr, hr) = best
                    splits[turns] = (k, cut)
                    del leaves[turns]
                    leaves |= {(*turns, 0): _value(gl, hl, rate), (*turns, 1): _value(gr, hr, rate)}
        if not splits:
            break
        model.trees.append(_nested(splits, leaves, ()))
    return model


def _value(g: int, h: int, rate: float) -> float:
    return round(rate * g / (h + _UNIT), 6)


def _gain(g: int, h: int) -> float:
    return g * g / (h + _UNIT)


def _best(histograms: dict, cuts: list) -> tuple | None:
    found, most = None, 1e-3 * _UNIT
    for k in sorted(histograms):
        bins = histograms[k]
        g, h = (sum(v[i] for v in bins.values()) for i in (0, 1))
        gl = hl = 0
        for b in sorted(bins):
            gl, hl = gl + bins[b][0], hl + bins[b][1]
            if b < len(cuts[k]) and (gain := _gain(gl, hl) + _gain(g - gl, h - hl) - _gain(g, h)) > most:
                found, most = (k, cuts[k][b], (gl, hl), (g - gl, h - hl)), gain
    return found


def _node(splits: dict, at: tuple, left: int) -> Column:
    """The turns that a row takes, as a text of 0 and 1."""
    if not left or at not in splits:
        return F.lit("".join(map(str, at)))
    k, cut = splits[at]
    return F.when(F.col(f"__{FEATURES[k]}") > cut, _node(splits, (*at, 1), left - 1)).otherwise(_node(splits, (*at, 0), left - 1))


def _nested(splits: dict, leaves: dict, at: tuple):
    if at not in splits:
        return leaves[at]
    return (*splits[at], _nested(splits, leaves, (*at, 0)), _nested(splits, leaves, (*at, 1)))


def judge(pages: DataFrame, model: UrlModel, url: str = "url", rules=URL_RULES) -> DataFrame:
    """pages with host, path, rule, score (log-odds of blocked) and verdict."""
    ruled = with_rule(pages.drop("host", "path", "rule", "rule_verdict", "score", "verdict"), url, rules)
    scored = model.featured(ruled, url).withColumn("score", model.score())
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return scored.withColumn("verdict", verdict).drop("rule_verdict", *[f"__{k}" for k in FEATURES])


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    """The labelled URLs are the pages that a rule decides; the trees judge all others."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    ruled = with_rule(pages, "url", URL_RULES)
    labelled = ruled.filter(F.col("rule_verdict").isNotNull()).select("url", (F.col("rule_verdict") == "block").cast("int").alias("blocked"))
    return judge(pages, fit(labelled)).select("page_id", "host", "path", "rule", "verdict", "score")
