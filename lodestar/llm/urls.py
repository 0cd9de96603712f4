"""URL filter: rules first, then gradient-boosted trees on lexical features, all in DataFrame functions.

Training sees at most ``sample_rows`` labelled URLs, binned and counted by distinct feature bins in one aggregate; the
driver grows the trees on these rows, bounded by the sample. The model is a sum of CASE expressions over the bins, and
suffix statistics are a lookup in a literal map.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path as the text of ``url`` gives them; both empty without ``://``."""
    part = lambda pattern: F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    return F.translate(part("://([^/?#]*)"), UPPER, LOWER), part("://[^/?#]*([^?#]*)")


def rule_of(host: F.Column, path: F.Column, rules: list[tuple[str, str]]) -> tuple[F.Column, F.Column]:
    """The longest rule that fits, and its verdict. ``rules``: (verdict, 'host/path'), a short list."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: len(r[1])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def lexical_features(url: F.Column, host: F.Column, path: F.Column) -> dict[str, F.Column]:
    """Length, depth, digit ratio, character entropy, parameters and host shape of a URL; zeros for null or empty."""
    u = F.coalesce(url, F.lit(""))
    n = F.length(u).cast("double")
    count = lambda c: F.length(u) - F.length(F.replace(u, c, F.lit("")))
    distinct = F.array_distinct(F.filter(F.split(u, ""), lambda c: F.length(c) > 0))
    entropy = F.aggregate(distinct, F.lit(0.0), lambda a, c: a - count(c) / n * F.log2(count(c) / n))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    return {
        "length": n,
        "path_length": F.length(path).cast("double"),
        "depth": F.regexp_count(path, F.lit("/[^/]+")).cast("double"),
        "digit_ratio": F.when(n > 0, F.regexp_count(u, F.lit("[0-9]")) / n).otherwise(0.0),
        "entropy": F.coalesce(entropy, F.lit(0.0)),
        "parameters": F.regexp_count(query, F.lit("[^&]+")).cast("double"),
        "labels": F.regexp_count(host, F.lit("[^.]+")).cast("double"),
        "hyphens": count(F.lit("-")).cast("double"),
    }


@dataclass
class Boosted:
    """Trees over bins: ``trees`` are lists of (feature, bin) splits by heap position and of leaf values."""

    edges: dict[str, list[float]] = field(default_factory=dict)
    suffix_rate: dict[str, float] = field(default_factory=dict)
    other: float = 0.5
    base: float = 0.0
    trees: list[tuple[dict[int, tuple[str, int]], dict[int, float]]] = field(default_factory=list)

    def binned(self, values: dict[str, F.Column]) -> dict[str, F.Column]:
        return {f: reduce(lambda a, e: a + (values[f] > F.lit(e)).cast("int"), es, F.lit(0)) for f, es in self.edges.items()}

    @staticmethod
    def value(tree, at: int = 1) -> F.Column:
        splits, leaves = tree
        if at not in splits:
            return F.lit(leaves.get(at, 0.0))
        f, b = splits[at]
        return F.when(F.col("b_" + f) <= b, Boosted.value(tree, 2 * at)).otherwise(Boosted.value(tree, 2 * at + 1))

    def margin(self) -> F.Column:
        return reduce(lambda a, t: a + self.value(t), self.trees, F.lit(self.base))


def _suffix(host: F.Column) -> F.Column:
    return F.regexp_extract(host, r"([^.]*)$", 1)


def _rate(suffix: F.Column, rates: dict[str, float], other: float) -> F.Column:
    """The statistics of a suffix, from a literal map of at most ``suffixes`` entries."""
    if not rates:
        return F.lit(other)
    pairs = [F.lit(x) for kv in sorted(rates.items()) for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), suffix), F.lit(other))


def fit_boosted(
    labelled: DataFrame, features: list[str], trees: int = 8, depth: int = 3, rate: float = 0.4, bins: int = 16, l2: float = 1.0, sample_rows: int = 20_000, suffixes: int = 64
) -> Boosted:
    """Fit on (url_key, suffix, label 0/1 and the feature columns) of at most ``sample_rows`` rows, the first by md5.

    Suffix statistics are the smoothed block rate of the ``suffixes`` most frequent host suffixes of that sample.
    Without labels, or with one class, the model is a constant.
    """
    scratch = Scratch(labelled.sparkSession)
    sample = scratch.write(
        labelled.orderBy(F.md5("url_key"), "url_key", "label").limit(sample_rows).repartition(4, "url_key")
    )
    model = Boosted()
    n, ones = sample.agg(F.count("*"), F.sum("label")).first()
    if not n or not ones or ones == n:
        model.base = -1.0 if not n else (8.0 if ones else -8.0)
        model.edges = {f: [] for f in (*features, "suffix_rate")}
        return model
    p0 = ones / n
    model.base, model.other = math.log(p0 / (1 - p0)), p0
    by = sample.groupBy("suffix").agg(
        F.count("*").alias("c"), F.sum("label").alias("y"),
    ).orderBy(F.desc("c"), "suffix").limit(suffixes).collect()
    model.suffix_rate = {r["suffix"]: (r["y"] + 10 * p0) / (r["c"] + 10) for r in by}
    values = {f: F.col(f) for f in features} | {"suffix_rate": _rate(F.col("suffix"), model.suffix_rate, p0)}
    quantiles = sample.agg(
        *[F.percentile_approx(c, [i / bins for i in range(1, bins)], 10_000).alias(f) for f, c in values.items()]
    ).first()
    model.edges = {f: sorted(set(quantiles[f])) for f in values}
    binned = sample.select("label", *[c.alias(f) for f, c in values.items()]).select(
        "label", *[c.alias(f"b_{f}") for f, c in model.binned({f: F.col(f) for f in values}).items()]
    )
    counted = binned.groupBy(*binned.columns).agg(F.count("*").alias("n")).orderBy(*binned.columns).collect()  # at most sample_rows rows
    scratch.drop(sample)
    table = np.array([list(r) for r in counted])
    label, times, x = table[:, 0].astype(float), table[:, -1].astype(float), table[:, 1:-1].astype(np.int64)
    margin = np.full(len(label), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = times * (label - p), times * p * (1 - p)
        splits: dict[int, tuple[str, int]] = {}
        leaf = np.ones(len(label), np.int64)
        for level in range(depth):
            for node in range(2**level, 2 ** (level + 1)):
                here = np.flatnonzero(leaf == node)
                found = best_split(x[here], g[here], h[here], l2) if len(here) else None
                if found:
                    f, b = found
                    splits[node] = (list(values)[f], b)
                    leaf[here] = 2 * node + (x[here, f] > b)
        if not splits:
            break
        leaves = {k: float(rate * g[leaf == k].sum() / (h[leaf == k].sum() + l2)) for k in np.unique(leaf).tolist()}
        model.trees.append((splits, leaves))
        margin += np.array([leaves[k] for k in leaf.tolist()])
    return model


def best_split(x: np.ndarray, g: np.ndarray, h: np.ndarray, l2: float) -> tuple[int, int] | None:
    """Feature and last bin of the left side that gain most, if any; ties to the first."""
    best = (1e-9, None)
    all_g, all_h = g.sum(), h.sum()
    for f in range(x.shape[1]):
        bins = x[:, f].max() + 1
        left_g, left_h = (np.cumsum(np.bincount(x[:, f], v, bins))[:-1] for v in (g, h))
        seen = np.cumsum(np.bincount(x[:, f], minlength=bins))[:-1]
        if not len(left_g):
            continue
        gain = left_g**2 / (left_h + l2) + (all_g - left_g) ** 2 / (all_h - left_h + l2) - all_g**2 / (all_h + l2)
        gain[(seen == 0) | (seen == len(x))] = 0
        b = int(np.argmax(gain))
        if gain[b] > best[0] * (1 + 1e-12):
            best = (gain[b], (f, b))
    return best[1]


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url", threshold: float = 0.5,
    **fit,
) -> DataFrame:
    """Verdict of every row: ``key``, host, path, rule, verdict (allow or block), score (the trees' block probability).

    URLs that a rule decides are the labelled URLs that the trees learn from; every other URL gets the trees' verdict.
    Null URLs and such without ``://`` have an empty host and path and the verdict of empty features. Repeated rows
    are judged alike, an empty table gives an empty result, other columns are ignored.
    """
    host, path = host_and_path(F.col("u"))
    parts = pages.select(
        F.col(key).alias("k"), F.col(url).cast("string").alias("u"),
    ).withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parts.withColumns({"rule": rule, "ruled": verdict})
    values = lexical_features(F.col("u"), F.col("host"), F.col("path"))
    rows = ruled.withColumns(values).withColumn("suffix", _suffix(F.col("host")))
    labelled = rows.where("rule is not null").select(
        F.coalesce("u", F.lit("")).alias("url_key"), "suffix", (F.col("ruled") == "block").cast("int").alias("label"),
        *values,
    )
    model = fit_boosted(labelled, list(values), **fit)
    rated = rows.withColumn("suffix_rate", _rate(F.col("suffix"), model.suffix_rate, model.other))
    cols = {f: F.col(f) for f in (*values, "suffix_rate")}
    scored = rated.withColumns(
        {"b_" + f: c for f, c in model.binned(cols).items()}
    ).withColumn("score", 1 / (1 + F.exp(-model.margin())))
    tree = F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(
        F.col("k").alias(key), "host", "path", "rule", F.coalesce("ruled", tree).alias("verdict"), "score",
    )
