"""Direct scoring end to end: workload, cached translations, blind judging, facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import comparison_key, entry_id, fill_prompt, is_refusal, json_scores, numbered_blocks, sampled_places, seeded_order, translation_key
from ..operators.scores import parsed_scores, refused_scores
from ..sources.providers import Provider, through_cache
from ..sources.shared import few, settle

TRANSLATE = "Translate from {source} into natural {target}. Answer 483 to refuse.\nText: `{text}`"
SCORE = "Score each translation into {target} from 0 to 100; end with a fenced JSON list of id and score.\nOriginal: ```{text}```\n{list}"


def workload(languages: DataFrame, sentences: DataFrame, entries: DataFrame) -> DataFrame:
    """Every language, sentence (category, sentence) and system: lists of FEW rows at most are broadcast."""
    rows = sentences.crossJoin(few(languages.select("language"))).crossJoin(few(entries))
    return rows.withColumn(
        "tested_entry",
        entry_id(F.col("model_name"), F.col("model_company"), F.col("service"), F.col("temp_key"), F.col("thinking")),
    )


def latency_log(asked: DataFrame, calls: DataFrame) -> DataFrame:
    """Log rows of the calls that gave a usable text: ``asked`` has key, model_id, sentence_cat and sentence."""
    made = calls.where(
        F.col("value").isNotNull() & ~F.coalesce(is_refusal(F.col("value")), F.lit(True))
    ).select("key", F.col("seconds").alias("duration"))
    rows = asked.dropDuplicates(["key"]).join(made, "key")
    return rows.select(
        "model_id", "sentence_cat", "sentence", "duration", F.unix_timestamp().cast("double").alias("logged_at"),
    )


def failures(calls: DataFrame) -> DataFrame:
    """Calls that never succeeded, with the last error."""
    return calls.where("value is null").select("key", "attempts", "error")


def translate(
    work: DataFrame, cache: DataFrame, make: Callable[[], Provider], source: str = "English", **how,
) -> tuple[DataFrame, DataFrame]:
    """(work with translation, null if refused, and refused; the calls made). Failed calls are neither."""
    key = translation_key(F.lit(source), F.col("language"), F.col("tested_entry"), F.col("sentence"))
    asked = work.withColumns(
        {"key": key, "source": F.lit(source), "target": F.col("language"), "text": F.col("sentence")}
    )
    done, calls = through_cache(
        asked.withColumn("temperature", F.col("temp_key").try_cast("double")), cache, make, **how,
    )
    refused = F.coalesce(is_refusal(F.col("value")), F.lit(False))
    done = done.withColumn("refused", refused).withColumn("translation", F.when(~refused, F.col("value")))
    return done.drop("value", "source", "target", "text"), calls


def blind_lists(translated: DataFrame, judges: DataFrame, sampled: bool = False) -> DataFrame:
    """Equal texts once, numbered in an order that depends on the texts and the judge only.

    With ``sampled`` that is the order of ``sampled_places`` over the sorted texts, for judgements stored under it.
    """
    texts = translated.where("translation is not null").groupBy(
        "language", "sentence", "sentence_category", "translation",
    )
    texts = texts.agg(F.sort_array(F.collect_set("tested_entry")).alias("entries"))
    if sampled:
        return _sampled_lists(settle(texts), few(judges.select("judge")))
    whole = Window.partitionBy("language", "sentence", "judge")
    rows = texts.crossJoin(few(judges.select("judge")))
    seed = F.concat(
        F.array_join(F.array_sort(F.collect_list("translation").over(whole)), "|"), F.lit("-"), F.col("judge"),
    )
    rows = rows.withColumn("_o", seeded_order(seed, F.col("translation")))
    return rows.withColumn("id", F.row_number().over(whole.orderBy("_o")) - 1).drop("_o")


def _sampled_lists(texts: DataFrame, judges: DataFrame) -> DataFrame:
    """Texts numbered as they sort, which is told once for all judges, and joined with the places that each judge's seed
    draws. The seed is made of all texts of a sentence, so only they stand together in one row."""
    sorted_texts = Window.partitionBy("language", "sentence").orderBy("translation", "sentence_category", "entries")
    rows = texts.withColumn("_at", F.row_number().over(sorted_texts) - 1)
    lists = texts.groupBy("language", "sentence").agg(
        F.array_join(F.sort_array(F.collect_list("translation")), "|").alias("_list"), F.count("*").alias("_n"),
    )
    places = sampled_places(F.concat("_list", F.lit("-"), "judge"), F.col("_n"))
    drawn = lists.crossJoin(judges).select(
        F.col("language").alias("_language"), F.col("sentence").alias("_sentence"), "judge", F.posexplode(places).alias("id", "_place"),
    )
    here = F.col("language").eqNullSafe(F.col("_language")) & F.col("sentence").eqNullSafe(F.col("_sentence"))
    return rows.join(drawn, here & (F.col("_at") == F.col("_place"))).select(
        "language", "sentence", "sentence_category", "translation", "entries", "judge", "id",
    )


def prompts(blind: DataFrame, template: str = SCORE) -> DataFrame:
    """(language, sentence, judge, prompt, key): one prompt for each judge of a sentence, with the whole blind list."""
    lists = blind.groupBy("language", "sentence", "judge").agg(
        F.sort_array(F.collect_list(F.struct("id", "translation"))).alias("l")
    )
    prompt = fill_prompt(
        template, target=F.col("language"), text=F.col("sentence"), list=numbered_blocks(F.col("l.translation")),
    )
    rows = lists.select("language", "sentence", "judge", prompt.alias("prompt"))
    return rows.withColumn("key", comparison_key(F.col("prompt"), F.col("judge")))


def judge(
    blind: DataFrame, cache: DataFrame, make: Callable[[], Provider], template: str = SCORE,
) -> tuple[DataFrame, DataFrame]:
    """(language, sentence, judge, scores; the calls made). A response that can't be read voids that judge's row only."""
    done, calls = through_cache(prompts(blind, template).withColumn("temperature", F.lit(0.0)), cache, make)
    return done.select("language", "sentence", "judge", json_scores("value").alias("scores")), calls


def score_facts(translated: DataFrame, blind: DataFrame, judged: DataFrame, judges: DataFrame) -> DataFrame:
    """Scores of all systems that gave a text, and refusals for every judge whose response on the sentence could be read.

    A sentence that every system refused has nothing to read: it gives refusals for all ``judges``.
    """
    good = judged.where("scores is not null")
    scored = parsed_scores(good, blind.select("language", "sentence", "judge", "id", "translation", "entries"))
    refused = translated.where("refused").select("language", "sentence", "tested_entry")
    nothing = refused.select("language", "sentence").distinct().join(
        translated.where("translation is not null"), ["language", "sentence"], "left_anti",
    )
    silent = nothing.crossJoin(few(judges.select("judge"))).withColumn(
        "scores", F.array().cast(judged.schema["scores"].dataType),
    )
    return scored.unionByName(refused_scores(refused, good.unionByName(silent)))
