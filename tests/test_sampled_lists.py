"""Sampled blind lists of long sentences' lists, and of languages that are not known."""

import random
import time

from pyspark.sql import functions as F

from lodestar.plans import scoring

WORK = "language string, sentence string, sentence_category string, translation string, tested_entry string"


def test_long_lists_are_drawn_in_linear_time(spark):
    n = 20_000
    texts = F.concat(F.lit("t"), F.sha2(F.col("id").cast("string"), 256)).alias("translation")
    done = spark.range(n).select(
        F.lit("L").alias("language"), F.lit("s").alias("sentence"), F.lit("c").alias("sentence_category"), texts,
        F.lit("m").alias("tested_entry"),
    )
    judges = spark.createDataFrame([("j1",), ("j2",)], "judge string")
    began = time.time()
    found = scoring.blind_lists(done, judges, sampled=True).select("judge", "id", "translation").collect()
    assert time.time() - began < 60  # a list in every row takes minutes
    distinct = sorted(r.translation for r in done.select("translation").collect())
    for j in ("j1", "j2"):
        order = random.Random("|".join(distinct) + "-" + j).sample(distinct, n)
        assert [r.translation for r in sorted(x for x in found if x.judge == j)] == order


def test_unknown_language_and_two_categories(spark):
    rows = [(None, "s", "c", "x", "m1"), (None, "s", "d", "x", "m2"), (None, "s", None, "y", "m3"), ("L", None, "c", "z", "m1")]
    got = scoring.blind_lists(spark.createDataFrame(rows, WORK), spark.createDataFrame([("j",)], "judge string"), sampled=True)
    found = {(r.language, r.sentence, r.id): (r.translation, r.sentence_category, r.entries) for r in got.collect()}
    listed = [("x", "c", ["m1"]), ("x", "d", ["m2"]), ("y", None, ["m3"])]
    order = random.Random("x|x|y-j").sample(range(3), 3)
    assert found == {(None, "s", k): listed[at] for k, at in enumerate(order)} | {("L", None, 0): ("z", "c", ["m1"])}
