"""Inference providers: one protocol for translating and judging, clients built inside the tasks that call them."""

from __future__ import annotations

import hashlib
import random
import time
from collections.abc import Callable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .overlap import Pace, overlapped
from .shared import settle

#: Languages with the codes of two services; no code means the service lacks the language.
LANGUAGES = [
    ("English", "EN", "en_US"), ("German", "DE", "de_DE"), ("Chinese", "ZH", "zh-Hans_CN"),
    ("Hungarian", "HU", "hu_HU"), ("French", "FR", "fr_FR"), ("Japanese", "JA", "ja_JP"), ("Italian", "IT", "it_IT"),
    ("EuropeanSpanish", "ES", "es_ES"), ("Ukrainian", "UK", "uk_UA"), ("Swedish", "SV", "sv_SE"),
    ("Korean", "KO", "ko_KR"), ("Thai", None, None), ("Welsh", None, None), ("Swahili", None, None),
    ("Esperanto", None, "eo_WORLD"),
]
LANGUAGE_SCHEMA = "language string, deepl_code string, lingvanex_code string"


def languages(spark, targets_only: bool = False) -> DataFrame:
    out = spark.createDataFrame(LANGUAGES, LANGUAGE_SCHEMA).withColumn(
        "hybrid_code", F.when(F.col("language") == "EuropeanSpanish", "Spanish").otherwise(F.col("language")),
    )
    return out.where("language != 'English'") if targets_only else out


def supported(requests: DataFrame, codes: DataFrame, code: str) -> DataFrame:
    """Requests whose target language the service of column ``code`` has."""
    return requests.join(
        F.broadcast(codes.where(F.col(code).isNotNull())), requests.target == codes.language, "left_semi",
    )


class Provider(Protocol):
    """What a plan needs of a service: answers to prompts, translations, and which languages it takes."""

    def infer(self, prompt: str, temperature: float | None) -> str: ...

    def translate(self, source: str, target: str, text: str, temperature: float | None) -> str: ...

    def is_tl_valid(self, target: str) -> bool: ...


class OfflineProvider:
    """Answers that only depend on what is asked: for tests and dry runs."""

    def __init__(self, name: str = "offline", languages: set[str] | None = None):
        self.name, self.languages = name, languages

    def _digest(self, asked: str) -> str:
        return f"{self.name}:{hashlib.sha256(asked.encode()).hexdigest()[:16]}"

    def infer(self, prompt: str, temperature: float | None) -> str:
        return self._digest(f"{temperature}|{prompt}")

    def translate(self, source: str, target: str, text: str, temperature: float | None) -> str:
        if not self.is_tl_valid(target):
            raise ValueError(f"no {target}")
        return self._digest(f"{source}>{target}|{text}")

    def is_tl_valid(self, target: str) -> bool:
        return self.languages is None or target in self.languages


ANSWER = "key string, value string, seconds double, attempts int, error string"


def call(
    requests: DataFrame, make: Callable[[], Provider], attempts: int = 3, wait: float = 0.0, jitter: float = 0.0,
    at_once: int = 1, rate: float | None = None,
) -> DataFrame:
    """ANSWER for rows (key, prompt, temperature), or (key, source, target, text, temperature) to translate.

    One client a task; a call that fails is tried again after a wait that grows with each attempt, ``jitter`` is the
    longest random wait before a first one. ``at_once`` calls of a task overlap, so the client must allow that many
    threads, and a task starts at most ``rate`` calls a second, repeated ones included: a service sees both times the tasks that run.
    Answers keep the order of the rows.
    """
    translates = "prompt" not in requests.columns
    asked = ["source", "target", "text", "temperature"] if translates else ["prompt", "temperature"]

    def run(batches):
        client, pace = make(), Pace(rate)
        ask = client.translate if translates else client.infer

        def one(*row):
            value, error, began, i = None, None, time.time(), 0
            time.sleep(random.uniform(0, jitter))
            for i in range(attempts):
                pace.wait()
                try:
                    began = time.time()
                    value, error = ask(*row), None
                    break
                except Exception as e:  # a provider may raise anything
                    error = f"{type(e).__name__}: {e}"
                    if i + 1 < attempts:
                        time.sleep(wait * (i + 1))
            return value, time.time() - began, i + 1, error

        for batch in batches:
            out = list(overlapped(one, zip(*(batch.column(c).to_pylist() for c in asked)), at_once))
            columns = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.float64(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), *columns], names=["key", "value", "seconds", "attempts", "error"],
            )

    return requests.select("key", *asked).mapInArrow(run, ANSWER)


def through_cache(
    requests: DataFrame, cache: DataFrame, make: Callable[[], Provider], **how,
) -> tuple[DataFrame, DataFrame]:
    """(all requests with value, the calls as ANSWER): each missing key is asked once, and the answers are written before
    anything reads them, so no later plan or lost executor asks again. New cache rows are the calls with a value."""
    asked = settle(call(requests.join(cache, "key", "left_anti").dropDuplicates(["key"]), make, **how))
    known = cache.select("key", "value").unionByName(asked.where("value is not null").select("key", "value"))
    return requests.join(known, "key", "left"), asked
