"""Column functions on judged texts: refusals, verdicts, scores in free text, cache keys and prompts."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Refusal mark, refused score, judge names of rows made without a judge, verdict labels.
REFUSAL, REFUSED_SCORE, SKIP_JUDGE, AMPLIFIED_JUDGE = "483", -483.0, "483-skip", "Synthetic Amplified"
#: White space of ASCII (fixed value).
WHITE = " \t\n\x0b\x0c\r"
LABEL_A, LABEL_B, LABEL_TIE = "Translation A", "Translation B", "Identical"


def is_refusal(text: Column, short: int = 3) -> Column:
    """Too short, or holds the refusal mark. ``short=0`` gives the older rule, the mark alone."""
    marked = F.contains(text, F.lit(REFUSAL))
    return marked | (F.length(text) < short) if short else marked


def strip(text: Column) -> Column:
    """Without white space of any kind at either end (``trim`` alone removes spaces only)."""
    return F.btrim(text, F.lit(WHITE))


def last_line(response: Column) -> Column:
    return F.substring_index(strip(response), "\n", -1)


def verdict_of_line(last: Column, swapped: Column) -> Column:
    """'a', 'b' or 'tie'; null unless exactly one label is there. ``swapped``: A and B were exchanged."""
    has_a, has_b, tie = (F.contains(last, F.lit(x)) for x in (LABEL_A, LABEL_B, LABEL_TIE))
    one = has_a.cast("int") + has_b.cast("int") + tie.cast("int") == 1
    return F.when(one & tie, "tie").when(one & (has_a != swapped), "a").when(one, "b")


def verdict(response: Column, swapped: Column) -> Column:
    """The verdict of a response's last line."""
    return verdict_of_line(last_line(response), swapped)


def tail_score(response: Column) -> Column:
    """The last number of up to three digits in the last ten characters, if it lies in 0..100."""
    n = F.try_element_at(
        F.regexp_extract_all(F.substring(response, -10, 10), F.lit(r"\d{1,3}"), F.lit(0)), F.lit(-1),
    ).cast("int")
    return F.when(n.between(0, 100), n)


def coin_flip(key: Column) -> Column:
    """True by the lowest bit of the first byte of SHA-256, that of the second hexadecimal digit."""
    return F.substring(F.sha2(key, 256), 2, 1).isin(*"13579bdf")


def seeded_order(key: Column, text: Column) -> Column:
    """What to order texts by for a blind order that only depends on the texts and the judge."""
    return F.sha2(F.concat(key, F.lit("\u0001"), text), 256)


def json_scores(responses: Column) -> Column:
    """Scores in the last part between fences that is JSON, or in the whole response; else null: array of id and score.

    A part is read without the word json. Ids may be written 'ID 2', scores as strings. Null if what is found is not a list, or has an
    entry without an id that is a whole number or a score that is a number.
    """
    response = F.col(responses) if isinstance(responses, str) else responses
    parts = F.concat(F.reverse(F.split(response, "```")), F.array(response))
    # in brackets, so that what follows a value is an error: a part holds one value or isn't JSON
    value = lambda x: F.try_parse_json(F.concat(F.lit("["), F.replace(x, F.lit("json"), F.lit("")), F.lit("]")))
    read = F.transform(parts, lambda x: F.try_variant_get(value(x), "$", "array<variant>"))
    whole = F.try_element_at(F.filter(read, lambda x: F.size(x) == 1), F.lit(1))
    listed = F.try_variant_get(F.try_element_at(whole, F.lit(1)), "$", "array<variant>")
    number = lambda x: F.btrim(F.replace(F.try_variant_get(x, "$.id", "string"), F.lit("ID"), F.lit("")), F.lit(WHITE))
    entry = lambda x: F.struct(
        F.when(F.regexp_like(number(x), F.lit(r"^[+-]?[0-9]+$")), number(x).try_cast("int")).alias("id"),
        F.btrim(F.try_variant_get(x, "$.score", "string"), F.lit(WHITE)).try_cast("double").alias("score"),
    )
    entries = F.transform(listed, entry)
    return F.when(~F.exists(entries, lambda x: x["id"].isNull() | x["score"].isNull()), entries)


def sampled_places(key: Column, n: Column) -> Column:
    """``random.Random(key).sample(range(n), n)`` of Python's standard library: the blind order of judgements that were stored
    under that generator. Arrow batches go to a Python worker, as Spark has no Mersenne Twister; ``seeded_order`` needs none."""
    return _sampled(key, n)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _sampled(key: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if k is None or pd.isna(m) else random.Random(k).sample(range(int(m)), int(m)) for k, m in zip(key, n)])


def entry_id(name: Column, company: Column, service: Column, temperature: Column, thinking: Column) -> Column:
    """A system's identity, its parts joined without separator; absent parts read 'None'."""
    return F.concat(
        name, company, service, F.coalesce(temperature.cast("string"), F.lit("None")),
        F.coalesce(thinking, F.lit("None")),
    )


def translation_key(source: Column, target: Column, entry: Column, sentence: Column) -> Column:
    return F.concat(
        F.lit("TRANSLATION From Language:"), source, F.lit(" To Language: "), target, F.lit("|Model: "), entry,
        F.lit("|Sentence md5:"), F.md5(sentence),
    )


def comparison_key(prompt: Column, judge: Column) -> Column:
    return F.concat(F.lit("COMPARISON hash:"), F.md5(prompt), F.lit(" Model:"), judge)


def coin_flip_key(language: Column, category: Column, sentence: Column, judge: Column, a: Column, b: Column) -> Column:
    return F.concat(
        F.lit("COIN FLIP Language:"), language, F.lit("|Sentence cat:"), category, F.lit("|Sentence md5:"),
        F.md5(sentence), F.lit("|"), judge, F.lit("|"), a, F.lit("|"), b,
    )


def coherence_key(prompt: Column, judge: Column, temperature: Column) -> Column:
    return F.concat(F.md5(prompt), F.lit("|"), judge, F.lit("|"), temperature.cast("string"))


def fill_prompt(template: str, **values: Column) -> Column:
    """``template`` with each {name} replaced by a column."""
    out, rest = [], template
    while "{" in rest:
        text, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [F.lit(text), values[name]]
    return F.concat(*out, F.lit(rest))


def numbered_blocks(texts: Column) -> Column:
    """The blind list of a scoring prompt: texts numbered from 0, each in a fence."""
    return F.array_join(
        F.transform(
            texts, lambda t,
            i: F.concat(F.lit("Translation ID "), i.cast("string"), F.lit(":\n```"), t, F.lit("```\n")),
        ),
        "",
    )
