"""Judged facts derived from the star-schema test tables: system = supplier mod 8, sentence = order, and so on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import REFUSED_SCORE, SKIP_JUDGE, is_refusal


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _places(spark: SparkSession, d: str) -> DataFrame:
    """Each order's category and its customer's region."""
    o, c, n, r = (table(spark, d, x) for x in ("orders", "customer", "nation", "region"))
    region = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.col("r_name").alias("language"))
    who = c.join(region, c.c_nationkey == region.n_nationkey).select("c_custkey", "language")
    return o.join(who, o.o_custkey == who.c_custkey).select(
        "o_orderkey", F.col("o_orderpriority").alias("sentence_category"), "language",
    )


def rank_items(spark: SparkSession, d: str) -> DataFrame:
    """language, tested_entry, sentence, sentence_category, evaluating_model, translation, score."""
    items, places = table(spark, d, "lineitem"), _places(spark, d)
    return items.join(places, items.l_orderkey == places.o_orderkey).select(
        "language", F.concat(F.lit("m"), (F.col("l_suppkey") % 8).cast("string")).alias("tested_entry"),
        F.col("l_orderkey").cast("string").alias("sentence"), "sentence_category",
        F.col("l_returnflag").alias("evaluating_model"), F.col("l_partkey").cast("string").alias("translation"),
        F.when(F.col("l_discount") == 0, REFUSED_SCORE).otherwise(F.col("l_quantity") * 2).alias("score"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("seen"),
    )


def entry_sentence(spark: SparkSession, d: str) -> DataFrame:
    e = (F.col("l_suppkey") % 8).cast("int")
    return table(spark, d, "lineitem").groupBy("l_orderkey", e.alias("entry_id")).agg(
        (F.max("l_quantity") + 2 * F.max(F.col("l_suppkey") % 8)).alias("q"), F.min("l_discount").alias("d"),
    )


def comparisons(spark: SparkSession, d: str) -> DataFrame:
    """language, a_id, b_id, sentence, sentence_category, evaluating_model, a_success, b_success, identical."""
    es = entry_sentence(spark, d)
    a, b = (
        es.select(
            F.col("l_orderkey").alias("s"), F.col("entry_id").alias(f"{x}_id"), F.col("q").alias(f"{x}_q"),
            F.col("d").alias(f"{x}_d"),
        ) for x in "ab"
    )
    judges = spark.range(3).select(
        F.element_at(F.array(*map(F.lit, ("jA", "jB", "jC"))), (F.col("id") + 1).cast("int")).alias("judge"),
        F.element_at(F.array(*map(F.lit, (0.0, 4.0, 9.0))), (F.col("id") + 1).cast("int")).alias("tol"),
    )
    pairs = a.join(b, "s").where("a_id < b_id").crossJoin(F.broadcast(judges))
    places = _places(spark, d)
    a_no, b_no, gap = F.col("a_d") == 0, F.col("b_d") == 0, F.col("a_q") - F.col("b_q")
    return pairs.join(places, pairs.s == places.o_orderkey).select(
        "language", "a_id", "b_id", F.col("s").cast("string").alias("sentence"), "sentence_category",
        F.when(a_no | b_no, SKIP_JUDGE).otherwise(F.col("judge")).alias("evaluating_model"),
        F.when(a_no, False).when(b_no, True).otherwise(gap > F.col("tol")).alias("a_success"),
        F.when(b_no, False).when(a_no, True).otherwise(-gap > F.col("tol")).alias("b_success"),
        F.when(a_no | b_no, False).otherwise(F.abs(gap) <= F.col("tol")).alias("identical"),
    )


def coherence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("m"), (F.col("l_suppkey") % 8).cast("string")).alias("tested_entry"),
        F.col("l_returnflag").alias("sentence_cat"), F.col("l_orderkey").cast("string").alias("sentence"),
        F.col("l_linenumber").alias("depth"), F.col("l_linestatus").alias("evaluator"),
        F.greatest(F.lit(0.0), 100 - 3 * F.col("l_linenumber") - F.col("l_quantity")).cast("int").alias("score"),
    )


def latency(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.concat(F.lit("m"), (F.col("user_id") % 8).cast("string")).alias("model_id"),
        F.col("event_type").alias("sentence_cat"), F.col("props").alias("sentence"), F.col("value").alias("duration"),
        F.col("ts").alias("logged_at"),
    )


def translations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        "doc_id", F.col("lang").alias("language"), F.col("source").alias("tested_entry"),
        (F.col("doc_id") % 50).cast("int").alias("sentence_id"), F.col("text").alias("translation"),
        is_refusal(F.col("text")).alias("refused"),
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
