"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Class sums and cross products are one aggregate; the driver sees two d x d matrices whatever the corpus. Covariances
shrink towards the pooled one and its diagonal, the inverses of their Cholesky factors are cached in the model, and the
score is the logistic of the difference of Mahalanobis log densities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, bound_batches
from .textbytes import NOT_SPACE, RangeHash, batch_bytes, slices, word_bounds

FEATURES = [
    "words", "word_length", "upper", "digits", "symbols", "bars", "wide", "distinct", "repeats", "top_word", "pairs",
    "stops", "lines", "marked",
]
_class = lambda s: np.isin(np.arange(256), list(s))
#: Words' worth of the usual statistics that every document is given.
PRIOR_WORDS = 20.0
UPPER, DIGIT, STOP, WIDE = _class(range(65, 91)), _class(b"0123456789"), _class(b".?!"), np.arange(256) >= 128
BAR, SYMBOL = _class(b"|"), _class(b"#$%&*+/<=>@[\\]^_`{}~!")
LETTER = _class(range(65, 91)) | _class(range(97, 123)) | WIDE


def _share(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    p = x / np.maximum(n, 1)
    return np.log((p + 0.01) / (np.maximum(1 - p, 0) + 0.01))


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """FEATURES of each document of a buffer; a document without words has those of zero counts."""
    n = len(offsets) - 1
    if not len(data):
        data = np.full(1, 32, np.uint8)
    total = lambda mask: np.diff(
        np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))[np.minimum(offsets, len(data))]
    )
    s, e, first = word_bounds(NOT_SPACE[data] if len(data) else np.zeros(0, bool), np.minimum(offsets, len(data)))
    words, size = np.diff(first), np.diff(offsets)
    letters, wide = total(LETTER[data]), total(WIDE[data])
    h = RangeHash(data)(s, e)
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    pair = np.zeros(len(h), np.uint64)
    pair[1:] = h[:-1] * np.uint64(3) + h[1:]
    last = data[e - 1] if len(e) else np.zeros(0, np.uint8)
    marked = SYMBOL[last] | BAR[last]
    distinct, top, pairs, repeats, ends = (np.zeros(n) for _ in range(5))
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if b > a:
            x = np.sort(h[a:b])
            edge = np.flatnonzero(x[1:] != x[:-1])
            distinct[i] = len(edge) + 1
            top[i] = np.diff(np.concatenate(([-1], edge, [b - a - 1]))).max()
            repeats[i] = np.count_nonzero(same[a + 1 : b])
            ends[i] = np.count_nonzero(marked[a:b])
            if b - a > 1:
                y = np.sort(pair[a + 1 : b])
                pairs[i] = np.count_nonzero(y[1:] != y[:-1]) + 1
    log = np.log1p
    cols = [
        log(words), log(letters / np.maximum(words, 1)), _share(total(UPPER[data]), letters),
        _share(total(DIGIT[data]), size), _share(total(SYMBOL[data]), size), _share(total(BAR[data]), words),
        _share(wide, size),
        log(distinct) - 0.8 * log(words), _share(repeats, words), _share(top, words),
        log(pairs) - log(np.maximum(words - 1, 0)), _share(total(STOP[data]), words), _share(total(data == 10), words),
        _share(ends, words),
    ]
    return np.stack(cols, axis=1)


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors of the shrunk covariances and log prior of two classes; ``constant`` if one is missing.

    Statistics of few words say little: all but the word count are drawn to their ``center`` as if a document had
    PRIOR_WORDS more words of the usual kind.
    """

    center: np.ndarray
    means: list
    factors: list
    log_dets: list
    log_odds: float
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        words = np.expm1(x[:, :1])
        x = np.concatenate(
            (x[:, :1], self.center[1:] + (x[:, 1:] - self.center[1:]) * words / (words + PRIOR_WORDS)), axis=1,
        )
        density = [-0.5 * np.square((x - m) @ f.T).sum(axis=1) - d for m, f, d in zip(self.means, self.factors, self.log_dets)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.log_odds, -30, 30)))


def fit(labelled: DataFrame, columns: list[str], shrink: float = 0.15, ridge: float = 0.1) -> Discriminant:
    """Fit on all rows of (y, columns): y 0 or 1, the first column log(1 + words). Without rows of a class, the score is
    constant (0.5 without any)."""
    d = len(columns)
    labelled = labelled.where("y in (0, 1)")
    center = labelled.agg(*[F.avg(c).alias(c) for c in columns]).first()
    words = F.expm1(columns[0])
    drawn = lambda c: F.lit(center[c]) + (F.col(c) - F.lit(center[c])) * words / (words + PRIOR_WORDS)
    labelled = labelled.select("y", columns[0], *[drawn(c).alias(c) for c in columns[1:]])
    cross = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(columns)] + [F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"p{i}_{j}") for i, j in cross]
    got = {r["y"]: r for r in labelled.groupBy("y").agg(F.count("*").alias("n"), *sums).collect()}
    if len(got) < 2:
        return Discriminant(np.zeros(d), [], [], [], 0.0, {(): 0.5, (0,): 0.0, (1,): 1.0}[tuple(got)])
    n, means, scatter = {}, {}, {}
    for y, r in got.items():
        n[y], means[y] = r["n"], np.array([r[f"s{i}"] for i in range(d)]) / r["n"]
        m = np.zeros((d, d))
        for i, j in cross:
            m[i, j] = m[j, i] = r[f"p{i}_{j}"] / r["n"] - means[y][i] * means[y][j]
        scatter[y] = m
    pooled = sum(n[y] * scatter[y] for y in (0, 1)) / sum(n.values())
    factors, dets = [], []
    for y in (0, 1):
        w = shrink + (1 - shrink) * d / (d + n[y])
        c = (1 - w) * scatter[y] + w * pooled
        c = (1 - ridge) * c + ridge * np.diag(np.maximum(np.diag(c), 1e-4)) + 1e-6 * np.eye(d)
        lower = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(lower))
        dets.append(float(np.log(np.diag(lower)).sum()))
    return Discriminant(
        np.array([center[c] for c in columns]), [means[0], means[1]], factors, dets, float(np.log(n[1] / n[0])),
    )


def score_quality(
    docs: DataFrame, labels: DataFrame, train: F.Column | None = None, key: str = "doc_id", text: str = "text",
    label: str = "quality", threshold: float = 0.7, keep: bool = False,
    sample_rows: int = 50_000, **regular,
) -> DataFrame:
    """Score of every row: ``key``, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= threshold).

    ``train``: condition on the label's key (column k) that it must meet to be learned from. The model learns from the
    rows of at most ``sample_rows`` labels, the first by md5 of the key; with no labels all scores are 0.5. Labels with
    null keys or other than 0 and 1 aren't used; a key labelled twice counts twice. Null and empty texts have the
    statistics of zero counts. With ``keep``, returns the rows of ``docs`` that are predicted 1, with all their columns,
    instead. One pass over all texts: only labelled rows are measured for the fit.
    """
    bound_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    cols = ["f_" + f for f in FEATURES]

    def features(column):
        data, offsets = batch_bytes(column)
        for a, b in slices(offsets):
            yield a, b, statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])

    def measure(batches):
        for batch in batches:
            for a, b, x in features(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *(pa.array(x[:, i]) for i in range(x.shape[1]))],
                    names=["y", *cols],
                )

    marks = labels.select(
        F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y"),
    ).where("k is not null and y in (0, 1)")
    marks = marks.where(
        train if train is not None else F.lit(True)
    ).orderBy(F.md5(F.col("k").cast("string")), "k", "y").limit(sample_rows)
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    # bounded by sample_rows
    known = rows.join(F.broadcast(scratch.write(marks)), "k").select("y", "t")
    known = scratch.write(known.mapInArrow(measure, "y int, " + ", ".join(f"{c} double" for c in cols)))
    model = fit(known, cols, **regular)
    scratch.drop(known)

    at = docs.columns.index(text)

    def accepted(batches):
        for batch in batches:
            scores = [model.score(x) for _, _, x in features(batch.column(at))]
            yield batch.filter(pa.array(np.concatenate(scores) >= threshold)) if scores else batch

    def scores(batches):
        for batch in batches:
            for a, b, x in features(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(model.score(x))], names=["k", "score"],
                )

    if keep:
        return docs.mapInArrow(accepted, docs.schema)
    out = rows.mapInArrow(scores, f"k {docs.select(f'`{key}`').schema[0].dataType.simpleString()}, score double")
    return out.select(F.col("k").alias(key), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
