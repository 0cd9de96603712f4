"""Queries of the evaluation operators over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .fit_sql import fit_sql
from .functions.stats import normal_cdf, normal_quantile, phi_sql
from .functions.text import coin_flip, json_scores, seeded_order, tail_score, verdict
from . import model_queries, part_queries, plan_queries, store_queries
from .operators import coherence as coh
from .operators import davidson as dv
from .operators import pairing, pairwise, scores
from .sources import cache, fixtures, latency
from .sources.shared import settle
from .sources.sinks import as_json
from .streaming.latency import windowed

N = 8  # systems of the test facts


def _votes_key() -> F.Column:
    return F.concat(
        F.col("sentence"), F.lit("|"), F.col("a_id").cast("string"), F.lit("|"), F.col("b_id").cast("string"),
        F.lit("|"), F.col("evaluating_model"),
    )


def _joined(c: str) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("int").cast("string")), ",").alias(c)


def rank_group_scores(s: SparkSession, d: str) -> DataFrame:
    """Groups and scores in the order in which they are seen first."""
    return scores.group_scores_as_seen(fixtures.rank_items(s, d), "seen").select(*scores.KEYS, _joined("scores"), "place")


def rank_group_scores_sorted(s: SparkSession, d: str) -> DataFrame:
    return scores.group_scores(fixtures.rank_items(s, d)).select(*scores.KEYS, _joined("scores"))


def rank_summary_stats(s, d):
    return scores.summary(fixtures.rank_items(s, d))


def rank_refusal_rates(s, d):
    return scores.refusal_rates(fixtures.rank_items(s, d))


def rank_mannwhitney(s, d):
    return scores.mann_whitney(fixtures.rank_items(s, d))


def translation_dedup(s, d):
    t = scores.same_texts(fixtures.translations(s, d))
    return t.select(
        "language", "sentence_id", F.md5("translation").alias("text_md5"),
        F.array_join("entries", ",").alias("entries"), "n",
    )


def blind_order(s, d):
    t = fixtures.translations(s, d).where("not refused").select(
        "sentence_id", "doc_id",
        seeded_order(
            F.concat(F.lit("s"), F.col("sentence_id").cast("string"), F.lit("-jA")), F.md5("translation"),
        ).alias("o"),
    )
    return t.select(
        "sentence_id", "doc_id",
        (F.row_number().over(Window.partitionBy("sentence_id").orderBy("o", "doc_id")) - 1).alias("id"),
    )


def coin_flips(s, d):
    return fixtures.comparisons(s, d).groupBy("language", "evaluating_model").agg(
        F.count("*").alias("n"), F.count_if(coin_flip(_votes_key())).alias("heads"),
    )


def score_tail_parse(s, d):
    text = F.concat(F.lit("thoughts 99\nScore:\n"), (F.col("l_quantity") * 7).cast("int").cast("string"))
    return fixtures.table(s, d, "lineitem").groupBy(tail_score(text).alias("score")).agg(F.count("*").alias("n"))


def verdict_parse(s, d):
    last = F.element_at(
        F.array(
            *map(F.lit, ("Translation A", "Translation B", "Identical", "Translation A or Translation B", "unsure"))
        ),
        (F.col("l_partkey") % 5 + 1).cast("int"),
    )
    got = verdict(F.concat(F.lit("A better\n"), last, F.lit(" \n")), F.col("l_suppkey") % 2 == 1)
    return fixtures.table(s, d, "lineitem").select("l_returnflag", got.alias("verdict")).groupBy("l_returnflag", "verdict").agg(F.count("*").alias("n"))


def json_score_rows(s, d):
    body = F.concat(
        F.lit('Critique\n```json\n[{"id": "ID '), (F.col("l_partkey") % 4).cast("string"), F.lit('", "score": "'),
        F.col("l_quantity").cast("int").cast("string"), F.lit('"}, {"id": 9, "score": 50}]\n```'),
    )
    rows = fixtures.table(s, d, "lineitem").select("l_linenumber", F.explode(json_scores(body)).alias("x"))
    return rows.groupBy("l_linenumber", "x.id").agg(F.count("*").alias("n"), F.round(F.avg("x.score"), 6).alias("mean"))


def comparison_facts(s, d):
    text = lambda q: F.when(F.col(q + "_d") == 0, "483").otherwise(
        F.concat(F.lit(" t"), F.col(q + "_q").cast("int").cast("string"))
    )
    es = fixtures.entry_sentence(s, d)
    a, b = (
        es.select(
            F.col("l_orderkey").alias("k"), F.col("entry_id").alias(f"{x}_id"), F.col("q").alias(f"{x}_q"),
            F.col("d").alias(f"{x}_d"),
        ) for x in "ab"
    )
    pairs = a.join(b, "k").where("a_id < b_id").select(
        F.lit("German").alias("language"), F.col("k").cast("string").alias("sentence"),
        F.lit("c").alias("sentence_category"), "a_id", "b_id", text("a").alias("text_a"),
        F.concat(text("b"), F.lit("\n")).alias("text_b"),
        F.lit("jA").alias("judge"),
        F.when(F.col("k") % 7 == 0, "dunno").otherwise(
            F.concat(F.lit("x\nTranslation "), F.when(F.col("k") % 2 == 0, "A").otherwise("B"))
        ).alias("response"),
    )
    f = pairwise.facts(pairs)
    return f.groupBy("a_id", "b_id", "evaluating_model").agg(
        F.count("*").alias("n"), F.count_if("a_success").alias("a"), F.count_if("b_success").alias("b"),
        F.count_if("identical").alias("t"),
    )


def pair_counts(s, d):
    return pairwise.pair_counts(fixtures.comparisons(s, d), "language")


def triplet_votes(s, d):
    return pairwise.triplets(fixtures.comparisons(s, d))


def amplify_counts(s, d):
    return pairwise.amplified_counts(pairwise.amplify(fixtures.comparisons(s, d), "language"), "language")


def amplify_rows(s, d):
    rows = pairwise.amplified_rows(pairwise.amplify(fixtures.comparisons(s, d)))
    return rows.groupBy("a_id", "b_id", "evaluating_model").agg(
        F.count("*").alias("n"), F.count_if("identical").alias("t"),
    )


def consensus_by_category(s, d):
    return pairwise.consensus(fixtures.comparisons(s, d))


def judge_agreement(s, d):
    return pairwise.agreement(fixtures.comparisons(s, d))


def majority_vote(s, d):
    return pairwise.majority(fixtures.comparisons(s, d))


def majority_seen_first(s, d):
    """Ties go to the vote that was seen first; judges answer in the order of their names backwards."""
    order = F.when(F.col("evaluating_model") == "jC", 0).when(F.col("evaluating_model") == "jB", 1).otherwise(2)
    return pairwise.majority(fixtures.comparisons(s, d).withColumn("seen", order), "seen")


def judge_stats(s, d):
    judges = s.createDataFrame([("jA",), ("jB",), ("jC",), ("jZ",)], "judge string")
    return pairwise.judge_stats(fixtures.comparisons(s, d), judges)


def judge_subsets(s, d):
    return pairwise.subset_counts(fixtures.comparisons(s, d), "evaluating_model")


def category_subsets(s, d):
    return pairwise.subset_counts(fixtures.comparisons(s, d), "sentence_category")


def _entries(s, d):
    return fixtures.table(s, d, "supplier").select(
        (F.col("s_suppkey") % 5).alias("grp"), F.col("s_suppkey").alias("pos"), F.col("s_name").alias("entry"),
    )


def chain_pairs(s, d):
    return pairing.chain(_entries(s, d), "grp")


def chain_places(s, d):
    """Neighbouring customers of the orders of a nation's customers, in the order in which the pairs are seen first."""
    rows = fixtures.table(s, d, "orders").select(
        (F.col("o_custkey") % 3).alias("grp"), F.col("o_orderkey").alias("pos"), (F.col("o_custkey") % 7).alias("entry"),
    )
    return pairing.chain_in_order(rows, "grp")


def strided_pairs(s, d):
    return pairing.strided(_entries(s, d), 1, 3, 4, "grp")


def untested_pairs(s, d):
    """Of forty systems, the pairs that no line item has compared: its supplier's with that of its part, in either order."""
    every = pairing.all_pairs(s.range(40).select(F.col("id").cast("int").alias("id")))
    id_of = lambda c: (F.col(c) % 40).cast("int")
    met = fixtures.table(s, d, "lineitem").select(
        id_of("l_suppkey").alias("a_id"), (F.col("l_suppkey") * F.col("l_linenumber") % 40).cast("int").alias("b_id"),
    )
    return pairing.untested(every, pairing.tested(met))


def first_k_per_category(s, d):
    o = fixtures.table(s, d, "orders").select(F.col("o_orderpriority").alias("category"), "o_orderkey", "o_custkey")
    return pairing.first_k(o, "category", ["o_orderkey", "o_custkey"], 24)


def coherence_by_depth(s, d):
    return coh.by_depth(fixtures.coherence(s, d))


def coherence_by_category(s, d):
    return coh.by_category(fixtures.coherence(s, d), 2)


def _kv(s, d):
    e = fixtures.table(s, d, "events")
    return e.select(
        F.concat(F.col("event_type"), F.lit("|"), (F.col("user_id") % 50).cast("string")).alias("key"),
        F.col("event_id").cast("string").alias("value"), (F.timestamp_seconds(F.col("event_id"))).alias("updated_at"),
    )


def cache_probe(s, d):
    c = cache.latest(_kv(s, d).where("key not like '%7'"))
    req = fixtures.table(s, d, "events").select(
        F.concat(F.col("event_type"), F.lit("|"), (F.col("user_id") % 60).cast("string")).alias("key")
    )
    return cache.probe(req, c).groupBy("hit").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"))


def cache_upsert(s, d):
    """Odd events are the cache, even ones are written over it."""
    rows, even = _kv(s, d), F.col("value").cast("long") % 2 == 0
    return cache.upsert(cache.latest(rows.where(~even)), rows.where(even)).select("key", "value")


def cache_delete(s, d):
    c = cache.latest(_kv(s, d))
    return cache.delete(c, cache.keys(c).where("key like '%|1%'")).select("key", "value")


def latency_summary(s, d):
    return latency.summary(fixtures.latency(s, d))


def latency_windows(s, d):
    return windowed(fixtures.latency(s, d), "1 hour").select(
        F.col("start").cast("timestamp_ntz").alias("start"), "model_id", "n", "total",
    )


def normal_probabilities(s, d):
    z = (F.col("l_quantity") - 25.0) / 8.0
    return fixtures.table(s, d, "lineitem").select("l_quantity", F.round(normal_cdf(z), 6).alias("phi")).distinct()


def normal_quantiles(s, d):
    """The quantile of each quantity's share of 51, which is a number of its own in every row."""
    p = F.col("l_quantity") / 51.0
    return fixtures.table(s, d, "lineitem").select("l_quantity", F.round(normal_quantile(p), 9).alias("z")).distinct()


def _strengths(s, d):
    """Made of the suppliers: each of eight systems is as strong as it has suppliers and the last of them says."""
    k = F.col("s_suppkey")
    return fixtures.table(s, d, "supplier").groupBy((k % N).cast("int").alias("i")).agg(
        (F.count("*") + F.max(k) % 7 + F.col("i") + 0.5).alias("strength")
    ).withColumn("tie", F.lit(0.75))


def pair_entropy(s, d):
    p = dv.probabilities(_strengths(s, d))
    return p.select("i", "j", *[F.round(c, 6).alias(c) for c in ("p_i", "p_j", "p_tie", "entropy")])


def pair_entropy_top1(s, d):
    return dv.next_pair(
        dv.probabilities(_strengths(s, d)).withColumn("language", (F.col("i") % 2)), 0.9, "language",
    ).select("language", "i", "j", F.round("entropy", 6).alias("entropy"))


def _fit(s, d, *by):
    return dv.fit(pairwise.pair_counts(fixtures.comparisons(s, d), *by), N, *by)


def _bounded(fitted):
    """Intervals of a fit, its figures to the digits that don't depend on how it was found."""
    digits = {"theta": 6, "strength": 6, "tie": 6, "log_likelihood": 4}
    return dv.intervals(fitted).withColumns({c: F.round(c, n) for c, n in digits.items()})


def davidson_strengths(s, d):
    return _bounded(_fit(s, d, "language"))


def davidson_pvalues(s, d):
    return dv.p_values(_fit(s, d, "language"), "language")


def leaderboard(s, d):
    board = dv.leaderboard(_fit(s, d, "language"), "language")
    against = F.transform(F.array_sort(F.map_entries("p_vals")), lambda x: F.format_string("%s:%.4f", x["key"], x["value"]))
    return board.select("language", "i", "rank", "low", "mid", "high", "converged", F.array_join(against, ",").alias("p_vals"))


def _moments(counts, *by):
    counts = settle(counts)
    return dv.moments(counts, dv.fit(counts, N, *by), *by).where("points > 0 or expected > 0")


def davidson_moments(s, d):
    """Points won and expected of every system and language: equal at the maximum of the likelihood."""
    return _moments(pairwise.pair_counts(fixtures.comparisons(s, d), "language"), "language")


def judge_subset_fits(s, d):
    return _moments(judge_subsets(s, d), "mask", "size")


def category_subset_fits(s, d):
    return _moments(category_subsets(s, d), "mask", "size")


def amplified_fits(s, d):
    return _moments(amplify_counts(s, d), "language")


def amplified_judge_subset_fits(s, d):
    return _moments(pairwise.amplified_subset_counts(fixtures.comparisons(s, d), "evaluating_model"), "mask", "size")


def amplified_category_subset_fits(s, d):
    return _moments(pairwise.amplified_subset_counts(fixtures.comparisons(s, d), "sentence_category"), "mask", "size")


def leaderboard_subsets(s, d):
    return _bounded(dv.fit(judge_subsets(s, d), N, "mask"))


def leaderboard_amplified(s, d):
    return _bounded(dv.fit(amplify_counts(s, d), N, "language"))


def category_signal(s, d):
    found = dv.category_signal(fixtures.comparisons(s, d), N)
    return found.withColumns({c: F.round(c, 6) for c in ("spread", "width", "significant")})


def judge_correlation(s, d):
    c = fixtures.comparisons(s, d)
    return dv.correlations(_fit(s, d), dv.fit(pairwise.pair_counts(c, "evaluating_model"), N, "evaluating_model"))


def scored_document(s, d):
    items = fixtures.rank_items(s, d)
    entries = items.select("tested_entry").distinct().withColumn("model", F.struct(F.col("tested_entry").alias("name")))
    document = as_json(scores.document(items, entries, ["A", "N"], ["short"]), "models")
    return document.select("language", F.length("models").alias("size"), F.sha2("models", 256).alias("models_sha256"))


QUERIES = {f.__name__: f for f in (
    rank_group_scores, rank_group_scores_sorted, majority_seen_first, chain_places, rank_summary_stats, rank_refusal_rates, rank_mannwhitney, translation_dedup, blind_order,
    coin_flips, score_tail_parse, verdict_parse, json_score_rows, comparison_facts, pair_counts, triplet_votes,
    amplify_counts, amplify_rows, consensus_by_category, judge_agreement, majority_vote, judge_stats, judge_subsets,
    category_subsets, chain_pairs, strided_pairs, untested_pairs, first_k_per_category, coherence_by_depth,
    coherence_by_category, cache_probe, cache_upsert, cache_delete, latency_summary, latency_windows,
    normal_probabilities, normal_quantiles, pair_entropy, pair_entropy_top1, davidson_strengths, davidson_pvalues, leaderboard,
    leaderboard_subsets,
    leaderboard_amplified, category_signal, judge_correlation, scored_document, davidson_moments, judge_subset_fits,
    category_subset_fits, amplified_fits, amplified_judge_subset_fits, amplified_category_subset_fits,
)}

_RANK = """rank_items AS (
  SELECT r.r_name AS language, 'm' || (l.l_suppkey % 8)::VARCHAR AS tested_entry,
    o.o_orderpriority AS sentence_category, l.l_returnflag AS evaluating_model,
    CASE WHEN l.l_discount = 0 THEN -483::DOUBLE ELSE l.l_quantity * 2 END AS score,
    l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
    JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)"""
_ES = """es AS (SELECT l_orderkey, (l_suppkey % 8)::INT AS entry_id, max(l_quantity) + 2 * max(l_suppkey % 8) AS q,
  min(l_discount) AS d FROM lineitem GROUP BY ALL)"""
_COMP = _ES + """,
comp AS (
  SELECT r.r_name AS language, a.entry_id AS a_id, b.entry_id AS b_id, a.l_orderkey::VARCHAR AS sentence,
    o.o_orderpriority AS sentence_category,
    CASE WHEN a.d = 0 OR b.d = 0 THEN '483-skip' ELSE j.judge END AS evaluating_model,
    CASE WHEN a.d = 0 THEN false WHEN b.d = 0 THEN true ELSE a.q - b.q > j.tol END AS a_success,
    CASE WHEN b.d = 0 THEN false WHEN a.d = 0 THEN true ELSE b.q - a.q > j.tol END AS b_success,
    CASE WHEN a.d = 0 OR b.d = 0 THEN false ELSE abs(a.q - b.q) <= j.tol END AS identical
  FROM es a JOIN es b ON a.l_orderkey = b.l_orderkey AND a.entry_id < b.entry_id CROSS JOIN (VALUES ('jA', 0.0),
    ('jB', 4.0), ('jC', 9.0)) j(judge, tol)
  JOIN orders o ON a.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey),
votes AS (SELECT *, CASE WHEN a_success THEN 'win_a' WHEN b_success THEN 'win_b' WHEN identical THEN 'tie' END AS vote
  FROM comp),
trip AS (SELECT language, sentence_category, sentence, a_id, b_id, count(*) AS n, count_if(a_success)::BIGINT AS a,
  count_if(b_success)::BIGINT AS b, count_if(identical)::BIGINT AS t FROM comp GROUP BY ALL),
maj AS (
  SELECT sentence, a_id, b_id, vote AS majority, c AS votes FROM (
    SELECT *, row_number() OVER (PARTITION BY sentence, a_id, b_id ORDER BY c DESC, CASE vote WHEN 'win_a' THEN 0
      WHEN 'win_b' THEN 1 ELSE 2 END) AS k
    FROM (SELECT sentence, a_id, b_id, vote, count(*) AS c FROM votes WHERE vote IS NOT NULL GROUP BY ALL))
      WHERE k = 1)"""
_COH = """coh AS (SELECT 'm' || (l_suppkey % 8)::VARCHAR AS tested_entry, l_returnflag AS sentence_cat, l_orderkey AS sentence,
  l_linenumber AS depth, greatest(0, 100 - 3 * l_linenumber - l_quantity)::INT AS score FROM lineitem),
  it AS (SELECT tested_entry, sentence_cat, sentence, depth, avg(score) AS m FROM coh GROUP BY ALL)"""
_TR = """tr AS (SELECT doc_id, lang AS language, source AS tested_entry, (doc_id % 50)::INT AS sentence_id, text AS translation,
  (length(text) < 3 OR contains(text, '483')) AS refused FROM documents)"""
_KV = """kv AS (SELECT event_type || '|' || (user_id % 50)::VARCHAR AS key, event_id::VARCHAR AS value, event_id AS seen
  FROM events), latest AS (SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seen DESC,
  value DESC) AS k FROM kv) WHERE k = 1)"""
_PHI = phi_sql()
_SUB = """, vals AS (SELECT v, (row_number() OVER (ORDER BY v) - 1)::INT AS k, count(*) OVER () AS m
  FROM (SELECT DISTINCT {0} AS v FROM comp WHERE {0} <> '483-skip')),
sets AS (SELECT s.mask::INT AS mask, v, (count(*) OVER (PARTITION BY s.mask))::INT AS size FROM (SELECT unnest(range(1,
  (SELECT (1 << max(m))::BIGINT FROM vals))) AS mask) s JOIN vals ON (s.mask >> k) & 1 = 1)
SELECT mask, size, a_id AS i, b_id AS j, count_if(vote = 'win_a')::BIGINT AS w_ij,
  count_if(vote = 'win_b')::BIGINT AS w_ji, count_if(vote = 'tie')::BIGINT AS t_ij FROM votes JOIN sets ON {0} = v
  WHERE vote IS NOT NULL GROUP BY mask, size, a_id, b_id"""
#: Probabilities that the oracle compares with: the C library's error function, not the operator's formula.
_KNOWN = ", ".join(
    f"({q}::DOUBLE, {round(math.erfc(-(q - 25) / 8 / math.sqrt(2)) / 2, 6)!r}::DOUBLE)" for q in range(1, 51)
)
_QUANTILES = ", ".join(f"({q}::DOUBLE, {round(NormalDist().inv_cdf(q / 51), 9)!r}::DOUBLE)" for q in range(1, 51))
_ENT = """st AS (SELECT (s_suppkey % 8)::INT AS i,
  (count(*) + max(s_suppkey) % 7 + any_value(s_suppkey % 8))::DOUBLE + 0.5::DOUBLE AS s FROM supplier GROUP BY 1),
pr AS (SELECT a.i, b.i AS j, a.s AS si, b.s AS sj, 0.75::DOUBLE * sqrt(a.s * b.s) AS t,
  a.s + b.s + 0.75::DOUBLE * sqrt(a.s * b.s) AS d FROM st a JOIN st b ON a.i < b.i),
en AS (SELECT i, j, si / d AS p_i, sj / d AS p_j,
  t / d AS p_tie, -(si / d) * ln(si / d + 1e-12) - (sj / d) * ln(sj / d + 1e-12) - (t / d) * ln(t / d + 1e-12) AS entropy FROM pr)"""

ORACLE = {
    "rank_group_scores": f"""WITH {_RANK}, g AS (SELECT language, tested_entry, sentence_category, evaluating_model,
  string_agg(score::INT::VARCHAR, ',' ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, score) AS scores,
  min([l_orderkey, l_linenumber, l_partkey, l_suppkey]) AS first FROM rank_items GROUP BY ALL)
SELECT language, tested_entry, sentence_category, evaluating_model, scores, row_number() OVER (ORDER BY first, language,
  tested_entry, sentence_category, evaluating_model) - 1 AS place FROM g""",
    "majority_seen_first": f"""WITH {_COMP}, c AS (SELECT sentence, a_id, b_id, vote, count(*) AS c, min(CASE evaluating_model WHEN 'jC' THEN 0
  WHEN 'jB' THEN 1 ELSE 2 END) AS f FROM votes WHERE vote IS NOT NULL GROUP BY ALL)
SELECT sentence, a_id, b_id, vote AS majority, c AS votes FROM (SELECT *, row_number() OVER (PARTITION BY sentence, a_id, b_id
  ORDER BY c DESC, f, CASE vote WHEN 'win_a' THEN 0 WHEN 'win_b' THEN 1 ELSE 2 END) AS k FROM c) WHERE k = 1""",
    "chain_places": """WITH x AS (SELECT o_custkey % 3 AS grp, o_orderkey AS pos, o_custkey % 7 AS entry_a, lead(o_custkey % 7) OVER (PARTITION BY
  o_custkey % 3 ORDER BY o_orderkey) AS entry_b FROM orders), f AS (SELECT grp, entry_a, entry_b, min(pos) AS p FROM x
  WHERE entry_b IS NOT NULL GROUP BY ALL)
SELECT grp, entry_a, entry_b, row_number() OVER (PARTITION BY grp ORDER BY p) - 1 AS place FROM f""",
    "rank_group_scores_sorted": f"""WITH {_RANK} SELECT language, tested_entry, sentence_category, evaluating_model, string_agg(score::INT::VARCHAR, ','
  ORDER BY score) AS scores FROM rank_items GROUP BY ALL""",
    "rank_summary_stats": f"""WITH {_RANK}, k AS (SELECT *, row_number() OVER (PARTITION BY tested_entry ORDER BY score) AS rn,
  count(*) OVER (PARTITION BY tested_entry) AS m FROM rank_items) SELECT tested_entry, count(*) AS n,
  round(avg(score), 6) AS mean, max(CASE WHEN rn = m // 2 + 1 THEN score END) AS median,
  round(stddev_pop(score), 6) AS std, count_if(score = -483)::BIGINT AS refusals, round(avg(CASE
  WHEN score <> -483 THEN score END), 6) AS mean_scored FROM k GROUP BY tested_entry""",
    "rank_refusal_rates": f"""WITH {_RANK} SELECT language, tested_entry, count(*) AS n, count_if(score = -483)::BIGINT AS refusals,
  round(count_if(score = -483) / count(*), 6) AS rate FROM rank_items GROUP BY ALL""",
    "rank_mannwhitney": f"""WITH {_RANK}, c AS (SELECT tested_entry AS e, score AS x, count(*) AS c FROM rank_items GROUP BY ALL), n AS (SELECT e, sum(c)::DOUBLE AS n FROM c GROUP BY e),
p AS (SELECT a.e AS entry_a, b.e AS entry_b, a.n AS na, b.n AS nb FROM n a CROSS JOIN n b),
v AS (SELECT entry_a, entry_b, na, nb, x, sum(CASE WHEN side = 0 THEN c ELSE 0 END) AS a, sum(c) AS t FROM (SELECT p.*,
  x, c, 0 AS side FROM p JOIN c ON e = entry_a UNION ALL SELECT p.*, x, c, 1 FROM p JOIN c ON e = entry_b)
  GROUP BY ALL),
m AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY entry_a, entry_b ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING
  AND 1 PRECEDING), 0)::DOUBLE + (t::DOUBLE + 1) / 2 AS mid FROM v),
s AS (SELECT entry_a, entry_b, na, nb, sum(a::DOUBLE * mid) AS r,
  sum(t::DOUBLE * t::DOUBLE * t::DOUBLE - t::DOUBLE) AS ties FROM m GROUP BY ALL),
u AS (SELECT *, r - na * (na + 1) / 2 AS u,
  sqrt(na * nb / 12 * ((na + nb + 1) - ties / ((na + nb) * (na + nb - 1)))) AS sigma FROM s),
zs AS (SELECT *, greatest(0, (greatest(u, na * nb - u) - na * nb / 2 - 0.5::DOUBLE) / sigma) AS z FROM u), {_PHI}
SELECT entry_a, entry_b, u, round(CASE WHEN entry_a = entry_b THEN 1 ELSE least(1, 2 * tail) END, 6) AS p FROM phi""",
    "translation_dedup": f"""WITH {_TR} SELECT language, sentence_id, md5(translation) AS text_md5, string_agg(tested_entry, ','
  ORDER BY tested_entry) AS entries, count(*) AS n FROM tr WHERE NOT refused GROUP BY language, sentence_id, translation""",
    "blind_order": f"""WITH {_TR} SELECT sentence_id, doc_id, (row_number() OVER (PARTITION BY sentence_id ORDER BY sha256('s'
  || sentence_id::VARCHAR || '-jA' || chr(1) || md5(translation)), doc_id) - 1)::INT AS id FROM tr WHERE NOT refused""",
    "coin_flips": f"""WITH {_COMP} SELECT language, evaluating_model, count(*) AS n, count_if(substr(sha256(sentence || '|' || a_id::VARCHAR
  || '|' || b_id::VARCHAR || '|'
  || evaluating_model), 2, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f'))::BIGINT AS heads FROM comp GROUP BY ALL""",
    "score_tail_parse": r"WITH x AS (SELECT regexp_extract_all(right('thoughts 99' || chr(10) || 'Score:' || chr(10) || (l_quantity * 7)::INT::VARCHAR, 10), '\d{1,3}')[-1]::INT AS v FROM lineitem) SELECT CASE WHEN v BETWEEN 0 AND 100 THEN v END AS score, count(*) AS n FROM x GROUP BY 1",
    "verdict_parse": """SELECT l_returnflag, CASE WHEN l_partkey % 5 = 2 THEN 'tie' WHEN l_partkey % 5 > 2 THEN NULL
  WHEN (l_partkey % 5 = 0) <> (l_suppkey % 2 = 1) THEN 'a' ELSE 'b' END AS verdict, count(*) AS n FROM lineitem
  GROUP BY ALL""",
    "json_score_rows": """SELECT l_linenumber, (l_partkey % 4)::INT AS id, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem
  GROUP BY ALL UNION ALL SELECT l_linenumber, 9, count(*), 50.0::DOUBLE FROM lineitem GROUP BY ALL""",
    "comparison_facts": f"""WITH {_ES}, p AS (
  SELECT a.entry_id AS a_id, b.entry_id AS b_id, a.l_orderkey AS k, a.d = 0 AS a_no, b.d = 0 AS b_no, CASE
    WHEN a.d <> 0 THEN a.q END AS aq, CASE WHEN b.d <> 0 THEN b.q END AS bq FROM es a
    JOIN es b ON a.l_orderkey = b.l_orderkey AND a.entry_id < b.entry_id),
v AS (
  SELECT *, CASE WHEN a_no AND b_no THEN 'none' WHEN a_no THEN 'b' WHEN b_no THEN 'a' WHEN aq::INT = bq::INT THEN 'tie'
    WHEN k % 7 = 0 THEN NULL
    WHEN (k % 2 = 0) <> (substr(sha256('COIN FLIP Language:German|Sentence cat:c|Sentence md5:' || md5(k::VARCHAR)
      || '|jA|' || a_id::VARCHAR || '|' || b_id::VARCHAR), 2, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f')) THEN 'a'
      ELSE 'b' END AS v FROM p)
SELECT a_id, b_id, CASE WHEN a_no OR b_no THEN '483-skip' ELSE 'jA' END AS evaluating_model, count(*) AS n,
  count_if(v = 'a')::BIGINT AS a, count_if(v = 'b')::BIGINT AS b, count_if(v = 'tie')::BIGINT AS t FROM v
  WHERE v IS NOT NULL GROUP BY ALL""",
    "pair_counts": f"""WITH {_COMP} SELECT language, a_id AS i, b_id AS j, count_if(vote = 'win_a')::BIGINT AS w_ij,
  count_if(vote = 'win_b')::BIGINT AS w_ji, count_if(vote = 'tie')::BIGINT AS t_ij FROM votes WHERE vote IS NOT NULL
  GROUP BY ALL""",
    "triplet_votes": f"WITH {_COMP} SELECT sentence, a_id, b_id, n, a, b, t FROM trip",
    "amplify_counts": f"""WITH {_COMP} SELECT language, a_id AS i, b_id AS j, sum(CASE WHEN a > b THEN a * a - b * b ELSE 0 END)::BIGINT AS w_ij,
  sum(CASE WHEN b > a THEN b * b - a * a ELSE 0 END)::BIGINT AS w_ji, sum(CASE WHEN a = b THEN t * t
  ELSE 0 END)::BIGINT AS t_ij FROM trip WHERE a <> b OR t > 0 GROUP BY ALL""",
    "amplify_rows": f"""WITH {_COMP} SELECT a_id, b_id, 'Synthetic Amplified' AS evaluating_model, sum(CASE WHEN a = b THEN t * t
  ELSE abs(a * a - b * b) END)::BIGINT AS n, sum(CASE WHEN a = b THEN t * t ELSE 0 END)::BIGINT AS t FROM trip
  WHERE a <> b OR t > 0 GROUP BY a_id, b_id""",
    "consensus_by_category": f"""WITH {_COMP} SELECT sentence_category, round(avg(abs(a - b) - 0.5::DOUBLE * t) * 100, 6) AS consensus, count(*) AS n
  FROM trip GROUP BY ALL""",
    "judge_agreement": f"""WITH {_COMP} SELECT sentence_category, round(avg(greatest(a, b, t) / n), 6) AS agreement,
  round(avg((a + b) / n), 6) AS decisiveness, count(*) AS n FROM trip GROUP BY ALL""",
    "majority_vote": f"WITH {_COMP} SELECT * FROM maj",
    "judge_stats": f"""WITH {_COMP}, g AS (
  SELECT evaluating_model AS judge, count(*) AS decisions, count_if(vote = majority)::BIGINT AS agreements,
    count_if(vote = 'tie')::BIGINT AS ties, count_if(vote = 'win_a')::BIGINT AS a_wins,
    count_if(vote = 'win_b')::BIGINT AS b_wins
  FROM votes v JOIN maj m ON v.sentence = m.sentence AND v.a_id = m.a_id AND v.b_id = m.b_id WHERE vote IS NOT NULL
    GROUP BY ALL)
SELECT j.judge, coalesce(decisions, 0) AS decisions, coalesce(agreements, 0) AS agreements, coalesce(ties, 0) AS ties,
  coalesce(a_wins, 0) AS a_wins, coalesce(b_wins, 0) AS b_wins,
  round(coalesce(agreements / decisions, 0), 6) AS agreement_rate, round(coalesce(ties / decisions, 0), 6) AS tie_rate
    FROM (VALUES ('jA'), ('jB'), ('jC'), ('jZ')) j(judge) LEFT JOIN g ON g.judge = j.judge""",
    "judge_subsets": f"WITH {_COMP}" + _SUB.format("evaluating_model"),
    "category_subsets": f"WITH {_COMP}" + _SUB.format("sentence_category"),
    "chain_pairs": """SELECT * FROM (SELECT s_suppkey % 5 AS grp, s_name AS entry_a, lead(s_name) OVER (PARTITION BY s_suppkey % 5
  ORDER BY s_suppkey) AS entry_b FROM supplier) WHERE entry_b IS NOT NULL""",
    "strided_pairs": """WITH x AS (SELECT s_suppkey % 5 AS grp, s_suppkey AS pos, s_name AS entry, row_number() OVER (PARTITION BY s_suppkey % 5
  ORDER BY s_suppkey) - 1 AS i FROM supplier), y AS (SELECT grp, pos, lag(entry) OVER (PARTITION BY grp
  ORDER BY pos) AS entry_a, entry AS entry_b FROM x WHERE i >= 1 AND (i - 1) % 3 = 0), z AS (SELECT *,
  row_number() OVER (PARTITION BY grp ORDER BY pos)::INT AS n FROM y WHERE entry_a IS NOT NULL) SELECT grp, entry_a,
  entry_b, n FROM z WHERE n <= 4""",
    "untested_pairs": """SELECT x.i::INT AS i, y.j::INT AS j FROM range(40) x(i) JOIN range(40) y(j) ON x.i < y.j WHERE NOT EXISTS (SELECT 1
  FROM (SELECT DISTINCT l_suppkey % 40 AS a, l_suppkey * l_linenumber % 40 AS b FROM lineitem) WHERE (a = x.i
  AND b = y.j) OR (a = y.j AND b = x.i))""",
    "first_k_per_category": """SELECT * FROM (SELECT o_orderpriority AS category, o_orderkey, o_custkey,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey, o_custkey)::INT AS n FROM orders) WHERE n <= 24""",
    "coherence_by_depth": f"""WITH {_COH} SELECT tested_entry, depth, round(avg(m), 6) AS coherence FROM it GROUP BY ALL UNION ALL
  SELECT DISTINCT tested_entry, 0, 100.0::DOUBLE FROM coh""",
    "coherence_by_category": f"""WITH {_COH}, a AS (SELECT * FROM it WHERE depth = 2) SELECT s.tested_entry, c.sentence_cat,
  round(coalesce(avg(m), 0), 6) AS coherence FROM (SELECT DISTINCT tested_entry FROM a) s CROSS
  JOIN (SELECT DISTINCT sentence_cat FROM a) c LEFT JOIN a ON a.tested_entry = s.tested_entry
  AND a.sentence_cat = c.sentence_cat GROUP BY ALL""",
    "cache_probe": f"""WITH {_KV}, q AS (SELECT event_type || '|' || (user_id % 60)::VARCHAR AS key FROM events), c AS (SELECT * FROM latest
  WHERE key NOT LIKE '%7') SELECT c.key IS NOT NULL AS hit, count(*) AS n, count(DISTINCT q.key) AS keys FROM q LEFT
  JOIN c ON q.key = c.key GROUP BY 1""",
    "cache_upsert": """SELECT event_type || '|' || (user_id % 50)::VARCHAR AS key, max(event_id)::VARCHAR AS value FROM events GROUP BY ALL""",
    "cache_delete": f"WITH {_KV} SELECT key, value FROM latest WHERE key NOT LIKE '%|1%'",
    "latency_summary": """SELECT 'm' || (user_id % 8)::VARCHAR AS model_id, event_type AS sentence_cat, count(*) AS n,
  round(sum(value), 4) AS total, round(max(value), 4) AS longest FROM events GROUP BY ALL""",
    "latency_windows": """SELECT date_trunc('hour', ts)::TIMESTAMP AS start, 'm' || (user_id % 8)::VARCHAR AS model_id, count(*) AS n,
  round(sum(value), 4) AS total FROM events GROUP BY ALL""",
    "normal_probabilities": f"""SELECT l_quantity, phi FROM (SELECT DISTINCT l_quantity FROM lineitem) JOIN (VALUES {_KNOWN}) k(q,
  phi) ON l_quantity = q""",
    "normal_quantiles": f"""SELECT l_quantity, z FROM (SELECT DISTINCT l_quantity FROM lineitem) JOIN (VALUES {_QUANTILES}) k(q,
  z) ON l_quantity = q""",
    "pair_entropy": f"""WITH {_ENT} SELECT i, j, round(p_i, 6) AS p_i, round(p_j, 6) AS p_j, round(p_tie, 6) AS p_tie,
  round(entropy, 6) AS entropy FROM en""",
    "pair_entropy_top1": f"""WITH {_ENT} SELECT language, i, j, round(entropy, 6) AS entropy FROM (SELECT *, i % 2 AS language,
  row_number() OVER (PARTITION BY i % 2 ORDER BY entropy DESC, i, j) AS k FROM en WHERE entropy >= 0.9) WHERE k = 1""",
}

_POINTS = """ SELECT {0}, i, sum(points)::DOUBLE AS points, sum(points)::DOUBLE AS expected, sum(t)::BIGINT AS ties
  FROM (
  SELECT {0}, i, w_ij + t_ij / 2 AS points, t_ij AS t FROM counts UNION ALL SELECT {0}, j, w_ji + t_ij / 2, t_ij
    FROM counts) GROUP BY ALL HAVING sum(points) > 0"""
_AMPLIFIED_SUBSETS = """, vals AS (SELECT v, (row_number() OVER (ORDER BY v) - 1)::INT AS k, count(*) OVER () AS m
  FROM (SELECT DISTINCT {0} AS v FROM comp WHERE {0} <> '483-skip')),
sets AS (SELECT s.mask::INT AS mask, v, (count(*) OVER (PARTITION BY s.mask))::INT AS size FROM (SELECT unnest(range(1,
  (SELECT (1 << max(m))::BIGINT FROM vals))) AS mask) s JOIN vals ON (s.mask >> k) & 1 = 1),
got AS (SELECT mask, size, sentence, a_id, b_id, count_if(a_success)::BIGINT AS a, count_if(b_success)::BIGINT AS b,
  count_if(identical)::BIGINT AS t FROM comp JOIN sets ON {0} = v GROUP BY ALL),
counts AS (SELECT mask, size, a_id AS i, b_id AS j, sum(CASE WHEN a > b THEN a * a - b * b ELSE 0 END) AS w_ij, sum(CASE
  WHEN b > a THEN b * b - a * a ELSE 0 END) AS w_ji, sum(CASE WHEN a = b THEN t * t ELSE 0 END) AS t_ij FROM got
  GROUP BY ALL)"""


def _counts(sql: str) -> str:
    """A query of pair counts as the table ``counts`` of the same query."""
    mark = "SELECT mask" if "SELECT mask, size, a_id" in sql else "SELECT language, a_id"
    head, _, tail = sql.rpartition(mark)
    return f"{head.rstrip()}, counts AS ({mark}{tail})"


ORACLE |= {
    "davidson_moments": _counts(ORACLE["pair_counts"]) + _POINTS.format("language"),
    "amplified_fits": _counts(ORACLE["amplify_counts"]) + _POINTS.format("language"),
    "judge_subset_fits": _counts(ORACLE["judge_subsets"]) + _POINTS.format("mask, size"),
    "category_subset_fits": _counts(ORACLE["category_subsets"]) + _POINTS.format("mask, size"),
    "amplified_judge_subset_fits": f"WITH {_COMP}" + _AMPLIFIED_SUBSETS.format("evaluating_model") + _POINTS.format("mask, size"),
    "amplified_category_subset_fits": f"WITH {_COMP}" + _AMPLIFIED_SUBSETS.format("sentence_category") + _POINTS.format("mask, size"),
    "scored_document": f"""WITH {_RANK},
g AS (SELECT language, tested_entry, sentence_category, evaluating_model, string_agg(score::VARCHAR, ','
  ORDER BY score) AS scores FROM rank_items GROUP BY ALL),
e AS (SELECT tested_entry, row_number() OVER (ORDER BY tested_entry) - 1 AS id FROM (SELECT DISTINCT tested_entry
  FROM rank_items)),
c AS (SELECT l.language, e.id, e.tested_entry, coalesce(string_agg('{{"sentence_category":"' || sentence_category
  || '","evaluating_model":"' || evaluating_model || '","scores":[' || scores || ']}}', ',' ORDER BY sentence_category,
  evaluating_model), '') AS items
  FROM (SELECT DISTINCT language FROM rank_items) l CROSS JOIN e LEFT JOIN g ON g.language = l.language
    AND g.tested_entry = e.tested_entry GROUP BY ALL),
m AS (SELECT language, '[' || string_agg('{{"id":' || id::VARCHAR || ',"model":{{"name":"' || tested_entry
  || '"}},"comparison_items":[' || items || '],"compare_models":["A","N"],"sentence_types":["short"]}}', ','
  ORDER BY id) || ']' AS models FROM c GROUP BY language)
SELECT language, length(models)::INT AS size, sha256(models) AS models_sha256 FROM m""",
}
QUERIES |= part_queries.QUERIES | plan_queries.QUERIES | model_queries.QUERIES | store_queries.QUERIES
ORACLE |= part_queries.oracle(_RANK, _COH, _TR, _COMP, _PHI) | plan_queries.oracle(_COMP, _PHI)
ORACLE |= model_queries.oracle(_COMP)
ORACLE |= store_queries.oracle(_COMP, ORACLE["pair_counts"], ORACLE["davidson_moments"])


def _fitted(sql: str, by: str, rest: str) -> str:
    """``rest`` over the fit (see ``fit_sql``) of a query of pair counts by its column ``by``."""
    head = sql if ", counts AS (" in sql else _counts(sql)
    keyed = f", keyed AS (SELECT {by} AS g, i, j, w_ij, w_ji, t_ij FROM counts), "
    return head.replace("WITH ", "WITH RECURSIVE ", 1) + keyed + fit_sql(N) + rest


def _counts_by(by: str) -> str:
    return f"""WITH {_COMP}, counts AS (SELECT {by}, a_id AS i, b_id AS j, count_if(vote = 'win_a')::BIGINT AS w_ij,
  count_if(vote = 'win_b')::BIGINT AS w_ji, count_if(vote = 'tie')::BIGINT AS t_ij FROM votes WHERE vote IS NOT NULL GROUP BY ALL)"""


_Z = "1.959963984540054::DOUBLE"
_LOW, _HIGH = (f"round(exp(theta {sign} {_Z} * sqrt(var)), 4)" for sign in "-+")
_BOUNDS = f"{_LOW} AS low, round(exp(theta), 4) AS mid, {_HIGH} AS high"
_INTERVALS = f""" SELECT g AS {{0}}, i, round(theta, 6) AS theta, round(strength, 6) AS strength, round(tie, 6) AS tie,
  round(log_likelihood, 4) AS log_likelihood, true AS converged, {_BOUNDS}, 0.95::DOUBLE AS conf_level FROM fit"""
_WALD = f""", zs AS (SELECT *, abs(delta) / sqrt(var) AS z FROM between_them), {_PHI},
wald AS (SELECT g, i, j, round(least(1, 2 * tail), 4) AS p FROM phi)"""
ORACLE |= {
    "davidson_strengths": _fitted(ORACLE["pair_counts"], "language", _INTERVALS.format("language")),
    "leaderboard_amplified": _fitted(ORACLE["amplify_counts"], "language", _INTERVALS.format("language")),
    "leaderboard_subsets": _fitted(ORACLE["judge_subsets"], "mask", _INTERVALS.format("mask")),
    "intervals_as_searched": _fitted(ORACLE["pair_counts"], "language", f""",
sums AS (SELECT g, i, round(sum(c + 1.0::DOUBLE / {N}), 6) AS row_sum FROM cov GROUP BY g, i),
wide AS (SELECT f.g, f.i, theta, sqrt(var + 1.0::DOUBLE / {N}) * 0.6744897501960817::DOUBLE AS half, row_sum FROM fit f
  JOIN sums s ON f.g = s.g AND f.i = s.i)
SELECT g AS language, i, round(exp(theta - half), 4) AS low, round(exp(theta), 4) AS mid, round(exp(theta + half), 4) AS high,
  0.5::DOUBLE AS conf_level, 'searched' AS covariance, row_sum FROM wide"""),
    "davidson_pvalues": _fitted(
        ORACLE["pair_counts"], "language", _WALD + " SELECT g AS language, i, j, p, true AS converged FROM wald",
    ),
    "leaderboard": _fitted(ORACLE["pair_counts"], "language", _WALD + f""",
against AS (SELECT g, i, string_agg(j::VARCHAR || ':' || printf('%.4f', p), ',' ORDER BY j) AS p_vals FROM wald GROUP BY g, i)
SELECT f.g AS language, f.i, (row_number() OVER (PARTITION BY f.g ORDER BY theta DESC, f.i))::INT AS rank, {_BOUNDS},
  true AS converged, p_vals FROM fit f JOIN against a ON f.g = a.g AND f.i = a.i"""),
    "category_signal": _fitted(_counts_by("sentence_category"), "sentence_category", _WALD + f""",
of AS (SELECT g, stddev_pop(strength) AS spread, avg({_HIGH} - {_LOW}) AS width FROM fit GROUP BY g),
sig AS (SELECT g, avg(CASE WHEN p < 0.05 THEN 1.0 ELSE 0.0 END) AS significant FROM wald WHERE i < j GROUP BY g),
agreed AS (SELECT sentence_category, round(avg(greatest(a, b, t) / n), 6) AS agreement,
  round(avg((a + b) / n), 6) AS decisiveness, count(*) AS n FROM trip GROUP BY ALL),
x AS (SELECT agreed.*, spread, width, significant, round(0.3::DOUBLE * agreement + 0.1::DOUBLE * decisiveness + 0.25::DOUBLE * 10 * spread
  + 0.15::DOUBLE / (width + 1e-6::DOUBLE) + 0.2::DOUBLE * significant, 6) AS signal
  FROM agreed JOIN of ON of.g = sentence_category JOIN sig ON sig.g = sentence_category)
SELECT sentence_category, agreement, decisiveness, n, round(spread, 6) AS spread, true AS converged, round(width, 6) AS width,
  round(significant, 6) AS significant, true AS model_fitted, signal,
  (row_number() OVER (ORDER BY signal DESC, sentence_category))::INT AS rank FROM x"""),
    "judge_correlation": _fitted(
        _counts_by("evaluating_model").replace(", counts AS (", ", each AS (", 1) + """, counts AS (SELECT * FROM each UNION ALL
  SELECT '', i, j, sum(w_ij)::BIGINT, sum(w_ji)::BIGINT, sum(t_ij)::BIGINT FROM each GROUP BY i, j)""", "evaluating_model", """,
placed AS (SELECT g, i, strength, row_number() OVER (PARTITION BY g ORDER BY strength DESC, i) - 1 AS place FROM fit)
SELECT a.g AS evaluating_model, round(corr(a.strength, b.strength), 6) AS pearson, round(corr(a.place, b.place), 6) AS spearman,
  count(*) AS n FROM placed a JOIN placed b ON a.i = b.i AND b.g = '' AND a.g <> '' GROUP BY a.g"""),
}
