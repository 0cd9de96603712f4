"""Active learning: fit, pick the most uncertain untested pair of each language, compare, repeat; and round trips."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import davidson, pairing, pairwise
from ..sources.shared import settle


def learn(
    comparisons: DataFrame, n: int, compare: Callable[[DataFrame], DataFrame], threshold: float = 1.09054,
    rounds: int | None = None,
    keep: Callable[[DataFrame], DataFrame] = settle,
) -> tuple[DataFrame, int]:
    """(comparisons with those of all rounds, number of rounds that compared something).

    ``compare`` gets pairs (language, i, j) and returns comparison rows. Ends when no pair qualifies, at the latest when
    all pairs were compared. A round fits on pair counts, so old comparisons are counted once and only new ones added;
    ``keep`` writes what a round made, which cuts the lineage.
    """
    most = n * (n - 1) // 2 if rounds is None else rounds
    counts = keep(pairwise.pair_counts(comparisons, "language"))
    tested = keep(pairing.tested(comparisons, "language"))
    for done in range(most + 1):
        fitted = davidson.fit(counts, n, "language")
        pairs = pairing.untested(davidson.probabilities(fitted, "language"), tested, "language")
        chosen = keep(davidson.next_pair(pairs, threshold, "language").select("language", "i", "j"))
        if done == most or chosen.isEmpty():
            return comparisons, done
        new = keep(compare(chosen))
        comparisons = comparisons.unionByName(new)
        both = counts.unionByName(pairwise.pair_counts(new, "language"))
        counts = keep(both.groupBy("language", "i", "j").agg(*[F.sum(c).alias(c) for c in ("w_ij", "w_ji", "t_ij")]))
        picked = chosen.select(  # even if nothing came of it
            "language", F.col("i").alias("a_id"), F.col("j").alias("b_id"),
        )
        tested = keep(tested.unionByName(pairing.tested(picked, "language")).distinct())
    return comparisons, most


def round_trips(
    sentences: DataFrame, depth: int, forward: Callable[[DataFrame], DataFrame], back: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Texts after each of ``depth`` trips: ``forward`` and ``back`` map a column ``text``; a refusal (null) ends its chain,
    earlier depths stay."""
    out, now = None, sentences.withColumn("text", F.col("sentence"))
    for d in range(1, depth + 1):
        now = back(forward(now)).where("text is not null")
        at = now.withColumn("depth", F.lit(d))
        out = at if out is None else out.unionByName(at)
    return out
