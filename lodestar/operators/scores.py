"""Direct scores (0-100, -483 for a refusal): groups, summaries, the nested document, rank tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import exact_u_p, two_sided_p
from ..functions.text import REFUSED_SCORE
from ..sources.shared import few, settle
from .numbering import numbered

#: The largest sample that is tested exactly.
EXACT = 8
KEYS = ["language", "tested_entry", "sentence_category", "evaluating_model"]


def group_scores(items: DataFrame) -> DataFrame:
    """Scores of each (language, system, category, judge), sorted."""
    return items.groupBy(*KEYS).agg(F.sort_array(F.collect_list("score")).alias("scores"))


def group_scores_as_seen(items: DataFrame, seen: str) -> DataFrame:
    """Scores of each (language, system, category, judge) in the order of ``seen``, and place: groups count from 0 in the
    order of their first rows. ``seen`` sorts and tells rows apart (a number, or a struct of them)."""
    groups = items.groupBy(*KEYS).agg(
        F.sort_array(F.collect_list(F.struct(F.col(seen).alias("seen"), "score"))).alias("all"), F.min(seen).alias("first"),
    )
    placed = numbered(groups.select(*KEYS, "first", F.col("all.score").alias("scores")), ["first", *KEYS])
    return placed.drop("first")


def summary(items: DataFrame, judges: list[str] | None = None, categories: list[str] | None = None) -> DataFrame:
    """Per system: mean, upper median and population deviation with refusals as -483, and the mean without them."""
    if judges is not None:
        items = items.where(F.col("evaluating_model").isin(judges))
    if categories is not None:
        items = items.where(F.col("sentence_category").isin(categories))
    # scores take about a hundred values: count these per system, then rank the counts
    counts = items.where("score is not null").groupBy("tested_entry", "score").agg(F.count("*").alias("c"))
    w = Window.partitionBy("tested_entry")
    upto = F.sum("c").over(w.orderBy("score").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumns({"n": F.sum("c").over(w), "upto": upto})
    middle = (F.col("upto") > F.floor(F.col("n") / 2)) & (F.col("upto") - F.col("c") <= F.floor(F.col("n") / 2))
    refused, total = F.col("score") == REFUSED_SCORE, lambda x, when=None: F.sum(
        F.when(when, x * F.col("c")) if when is not None else x * F.col("c")
    )
    sums = ranked.groupBy("tested_entry").agg(
        F.sum("c").alias("n"), total(F.col("score")).alias("s"), F.max(F.when(middle, F.col("score"))).alias("median"),
        F.coalesce(F.sum(F.when(refused, F.col("c"))), F.lit(0)).alias("refusals"),
        total(F.col("score"), ~refused).alias("given"), F.collect_list(F.struct("score", "c")).alias("all"),
    )
    mean = F.col("s") / F.col("n")
    square = F.aggregate("all", F.lit(0.0), lambda a, x: a + x["c"] * (x["score"] - mean) * (x["score"] - mean))
    return sums.select(
        "tested_entry", "n", F.round(mean, 6).alias("mean"), "median",
        F.round(F.sqrt(square / F.col("n")), 6).alias("std"), "refusals",
        F.round(F.try_divide(F.col("given"), F.col("n") - F.col("refusals")), 6).alias("mean_scored"),
    )


def score_counts(items: DataFrame) -> DataFrame:
    """Rows per score of each (language, system, category, judge): what summaries and rank tests need, of bounded size."""
    return items.groupBy(*KEYS, "score").agg(F.count("*").alias("n"))


def refusal_rates(items: DataFrame) -> DataFrame:
    r = F.count_if(F.col("score") == REFUSED_SCORE)
    return items.groupBy("language", "tested_entry").agg(
        F.count("*").alias("n"), r.alias("refusals"), F.round(r / F.count("*"), 6).alias("rate"),
    )


def document(
    items: DataFrame, entries: DataFrame, judges: list[str] | None = None, categories: list[str] | None = None,
) -> DataFrame:
    """One row per language: all systems of ``entries`` (tested_entry, model), each with its score groups, empty if none,
    and with the names of all ``judges`` and ``categories`` where they are given."""
    groups = group_scores(items).groupBy("language", "tested_entry").agg(
        F.sort_array(
            F.collect_list(F.struct("sentence_category", "evaluating_model", "scores"))
        ).alias("comparison_items")
    )
    every = items.select("language").distinct().crossJoin(
        few(numbered(entries, ["tested_entry"], "id").withColumn("id", F.col("id").cast("int")))
    )
    rows = every.join(groups, ["language", "tested_entry"], "left").withColumn(
        "comparison_items", F.coalesce("comparison_items", F.array().cast(groups.schema["comparison_items"].dataType)),
    )
    lists = {"compare_models": judges, "sentence_types": categories}
    named = [F.array(*map(F.lit, v)).alias(k) for k, v in lists.items() if v is not None]
    return rows.groupBy("language").agg(
        F.sort_array(F.collect_list(F.struct("id", "model", "comparison_items", *named))).alias("models")
    )


def parsed_scores(judged: DataFrame, blind: DataFrame) -> DataFrame:
    """Facts from parsed scores: ``judged`` (language, sentence, judge, scores: array of id, score) and ``blind``
    (language, sentence, judge, id, translation, entries). Unknown ids go, repeated ids repeat, texts fan out to systems."""
    on = ["language", "sentence", "judge"]
    rows = judged.select(*on, F.explode("scores").alias("x")).select(*on, "x.id", "x.score")
    return rows.join(blind, [*on, "id"]).select(*on, "translation", "score", F.explode("entries").alias("tested_entry"))


def refused_scores(refusals: DataFrame, judged: DataFrame) -> DataFrame:
    """A -483 row for each refused (language, sentence, tested_entry) and judge whose response on the sentence parsed."""
    gate = judged.where("scores is not null").select("language", "sentence", "judge").distinct()
    return refusals.join(gate, ["language", "sentence"]).select(
        "language", "sentence", "judge", F.lit(None).cast("string").alias("translation"),
        F.lit(REFUSED_SCORE).alias("score"), "tested_entry",
    )


def same_texts(translations: DataFrame) -> DataFrame:
    """Systems that gave the same text for a sentence: judged once. Texts are compared exactly, refusals left out."""
    return translations.where("not refused").groupBy("language", "sentence_id", "translation").agg(
        F.sort_array(F.collect_list("tested_entry")).alias("entries"), F.count("*").alias("n"),
    )


def mann_whitney(items: DataFrame, system: str = "tested_entry", value: str = "score") -> DataFrame:
    """Two-sided U tests of all ordered pairs of systems: entry_a, entry_b, u, p.

    p is exact where a sample has ``EXACT`` values at most and none is tied, else normal, tie-corrected and continuous.
    Values are counted per system first, so pairs meet on value counts and not on rows; a system against itself has p 1.
    """
    counts = settle(items.groupBy(F.col(system).alias("e"), F.col(value).alias("x")).agg(F.count("*").alias("c")))
    systems = counts.groupBy("e").agg(F.sum("c").alias("n"))
    pairs = systems.select(F.col("e").alias("entry_a"), F.col("n").alias("n_a")).crossJoin(
        few(systems.select(F.col("e").alias("entry_b"), F.col("n").alias("n_b")))
    )
    side = lambda who, is_a: pairs.join(counts, F.col(who) == F.col("e")).select(
        "entry_a", "entry_b", "n_a", "n_b", "x", F.when(F.lit(is_a), F.col("c")).otherwise(0).alias("a"),
        F.col("c").alias("t"),
    )
    both = side("entry_a", True).unionAll(side("entry_b", False)).groupBy("entry_a", "entry_b", "n_a", "n_b", "x").agg(
        F.sum("a").alias("a"), F.sum("t").alias("t"),
    )
    below = Window.partitionBy("entry_a", "entry_b").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    ranked = both.withColumn("mid", F.coalesce(F.sum("t").over(below), F.lit(0)) + (F.col("t") + 1) / 2.0)
    t = F.col("t").cast("double")
    sums = ranked.groupBy("entry_a", "entry_b", "n_a", "n_b").agg(
        F.sum(F.col("a") * F.col("mid")).alias("r"), F.sum(t * t * t - t).alias("ties"),
    )
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n, u = na + nb, F.col("r") - na * (na + 1) / 2
    sigma = F.sqrt(na * nb / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = (F.greatest(u, na * nb - u) - na * nb / 2 - 0.5) / sigma
    small = (F.least("n_a", "n_b") <= EXACT) & (F.col("ties") == 0)
    normal = F.when(sigma == 0, 1.0).otherwise(two_sided_p(F.greatest(z, F.lit(0.0))))
    found = sums.select(
        "entry_a", "entry_b", "n_a", "n_b", u.alias("u"),
        F.when(F.col("entry_a") == F.col("entry_b"), 1.0).when(~small, normal).alias("p"),
    )
    exact = exact_u_p(F.when(F.col("p").isNull(), F.col("u")), F.col("n_a"), F.col("n_b"))
    return found.withColumn("_x", exact).select("entry_a", "entry_b", "u", F.round(F.coalesce("p", "_x"), 6).alias("p"))
