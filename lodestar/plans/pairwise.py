"""Pairwise judging end to end: short cuts, order by coin flip, cached judges, verdicts, facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import coin_flip, comparison_key, fill_prompt
from ..operators.pairwise import facts, flip_key, outcome_without_judge
from ..sources.providers import Provider, through_cache
from ..sources.shared import few

COMPARE = (
    "Compare two translations of one sentence by accuracy, words, grammar, tone, consistency and idiom; style is free. Think in few words.\n"
    "On a last line of its own write Translation A, Translation B or Identical.\nOriginal: ```{text}```\nA: ```{a}```\nB: ```{b}```"
)


def pairs(translated: DataFrame, chosen: DataFrame) -> DataFrame:
    """Both texts of each chosen pair (a_id, b_id) on every sentence: ``translated`` has language, sentence,
    sentence_category, id and text, refusals included. Pairs of a system with itself are refused by ``facts``."""
    on = ["language", "sentence", "sentence_category"]
    side = lambda x: translated.select(
        *on, F.col("id").alias(f"{x}_id"), F.col("text").alias(f"text_{x}"),
    )
    return side("a").join(chosen.select("a_id", "b_id").distinct(), "a_id").join(side("b"), [*on, "b_id"])


def prompts(judged: DataFrame, template: str = COMPARE) -> DataFrame:
    """``judged`` (pairs with judge) with flipped, prompt and key; the prompt shows the texts in the order of the flip."""
    rows = judged.withColumn("flipped", coin_flip(flip_key()))
    shown = lambda x, y: F.when(F.col("flipped"), F.col(y)).otherwise(F.col(x))
    prompt = fill_prompt(template, text=F.col("sentence"), a=shown("text_a", "text_b"), b=shown("text_b", "text_a"))
    return rows.withColumn("prompt", prompt).withColumn("key", comparison_key(F.col("prompt"), F.col("judge")))


def compare(
    rows: DataFrame, judges: DataFrame, cache: DataFrame, make: Callable[[], Provider], template: str = COMPARE,
) -> tuple[DataFrame, DataFrame]:
    """(comparison facts; the calls made). Only pairs of two different texts are put to the judges, each prompt once."""
    every = rows.crossJoin(few(judges.select("judge")))
    decided = outcome_without_judge().isNotNull()
    asked = prompts(every.where(~decided), template).withColumn("temperature", F.lit(0.0))
    answered, calls = through_cache(asked, cache, make)
    silent = every.where(decided).withColumn("response", F.lit(None).cast("string"))
    return facts(answered.withColumn("response", F.col("value")).select(*silent.columns).unionByName(silent)), calls


def readable(calls: DataFrame, facts_of: DataFrame) -> DataFrame:
    """New cache rows: the answers that gave a verdict; others are asked again next time."""
    return calls.join(
        facts_of.select(F.col("evaluating_response").alias("value")).distinct(), "value", "left_semi",
    ).select("key", "value")
