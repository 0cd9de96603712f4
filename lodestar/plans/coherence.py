"""Round-trip coherence end to end: systems by sentences, trips there and back, judges of what is left of the meaning."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import coherence_key, fill_prompt, is_refusal, tail_score, translation_key
from ..operators.pairing import first_k
from ..sources.providers import Provider, through_cache
from ..sources.shared import few
from .active import round_trips

RATE = (
    "Rate from 0 to 100 how close the new text is to the original in meaning and tone. Think in few words.\n"
    "Original text:\n```{text}```\nNew text:\n```{new}```\nOn a last line of its own write one whole number."
)


def tasks(entries: DataFrame, sentences: DataFrame, first: int | None = None) -> DataFrame:
    """Every system with every sentence, or with the first so many of each category: ``sentences`` has sentence_category,
    sentence_pos and sentence."""
    some = sentences if first is None else first_k(sentences, "sentence_category", ["sentence_pos"], first).drop("n")
    return some.crossJoin(few(entries))


def trip(
    cache: DataFrame, make: Callable[[], Provider], source: str, target: str, log: list[DataFrame],
) -> Callable[[DataFrame], DataFrame]:
    """A map of the column ``text`` from one language into another; refusals and failures end as null. ``log`` collects
    the calls."""

    def run(rows: DataFrame) -> DataFrame:
        key = translation_key(F.lit(source), F.lit(target), F.col("tested_entry"), F.col("text"))
        asked = rows.withColumns({"key": key, "source": F.lit(source), "target": F.lit(target)})
        known = reduce(
            DataFrame.unionByName, [x.where("value is not null").select("key", "value") for x in log],
            cache.select("key", "value"),
        )
        done, calls = through_cache(asked.where("text is not null"), known, make)
        log.append(calls)
        usable = ~F.coalesce(is_refusal(F.col("value")), F.lit(True))
        return done.withColumn("text", F.when(usable, F.col("value"))).drop("key", "source", "target", "value")

    return run


def rate(
    trips: DataFrame, evaluators: DataFrame, cache: DataFrame, make: Callable[[], Provider], template: str = RATE,
) -> tuple[DataFrame, DataFrame]:
    """(trips with evaluator and score, null if the answer has none; the calls made)."""
    rows = trips.crossJoin(few(evaluators.select(F.col("judge").alias("evaluator"))))
    prompt = fill_prompt(template, text=F.col("sentence"), new=F.col("text"))
    key = coherence_key(F.col("prompt"), F.col("evaluator"), F.lit(0))
    asked = rows.withColumn("prompt", prompt).withColumns({"key": key, "temperature": F.lit(0.0)})
    done, calls = through_cache(asked, cache, make)
    return done.withColumn("score", tail_score(F.col("value"))).drop("prompt", "key", "temperature", "value"), calls


def batch(
    work: DataFrame, evaluators: DataFrame, language: str, depth: int, cache: DataFrame, make: Callable[[], Provider],
    judge: Callable[[], Provider],
    source: str = "English",
) -> tuple[DataFrame, DataFrame]:
    """(rows of sentence_cat, sentence, depth, staged_text, evaluator, score, tested_entry; all calls made).

    ``work`` has tested_entry, temperature, sentence_category and sentence. A refusal ends a chain; what was reached
    before stays. All chains advance together, one depth at a time, each missing text asked for once.
    """
    log: list[DataFrame] = []
    there, back = trip(cache, make, source, language, log), trip(cache, make, language, source, log)
    trips = round_trips(work.select("tested_entry", "temperature", "sentence_category", "sentence"), depth, there, back)
    rated, judged = rate(trips, evaluators, cache, judge)
    rows = rated.select(
        F.col("sentence_category").alias("sentence_cat"), "sentence", "depth", F.col("text").alias("staged_text"),
        "evaluator", "score", "tested_entry",
    )
    return rows, reduce(DataFrame.unionByName, log, judged)


def nested(rows: DataFrame) -> DataFrame:
    """One row per text reached, with the list of its evaluations."""
    keys = ["sentence_cat", "sentence", "depth", "staged_text", "tested_entry"]
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("evaluator", "score"))).alias("evaluations"))
