"""Queries of the smaller parts: refusal rules, keys and prompts, workload, caches, score facts, model formulas, loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import coherence as coh
from .operators import davidson as dv
from .operators import pairing, pairwise, scores
from .plans import active, scoring
from .sources import cache, fixtures, providers

table = fixtures.table


def refusal_rules(s: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(s, d, "documents").groupBy("lang").agg(
        F.count_if(tx.is_refusal(t)).alias("refused"), F.count_if(tx.is_refusal(t, 0)).alias("marked"),
        F.count_if(tx.strip(t) == "").alias("blank"),
    )


def target_languages(s, d):
    """The languages that are translated into, with the orders that ask for each."""
    asked = _asked_languages(s, d).groupBy(F.col("target").alias("language")).agg(F.count("*").alias("n"))
    rows = providers.languages(s, targets_only=True).join(asked, "language", "left")
    return rows.withColumn("n", F.coalesce("n", F.lit(0)))


def _asked_languages(s, d):
    names = F.array(*[F.lit(x[0]) for x in providers.LANGUAGES])
    return table(s, d, "orders").select(
        F.element_at(names, (F.col("o_custkey") % len(providers.LANGUAGES) + 1).cast("int")).alias("target")
    )


def language_support(s, d):
    asked = _asked_languages(s, d)
    codes = providers.languages(s)
    of = lambda code: providers.supported(asked, codes, code).select(F.lit(code).alias("service"), "target")
    return of("deepl_code").unionByName(of("lingvanex_code")).unionByName(of("hybrid_code")).groupBy("service", "target").agg(F.count("*").alias("n"))


def _work(s, d):
    languages = table(s, d, "region").select(F.col("r_name").alias("language"))
    sentences = table(s, d, "nation").select(
        F.col("n_regionkey").cast("string").alias("sentence_category"), F.col("n_name").alias("sentence"),
    )
    k = F.col("s_suppkey") % 8
    entries = table(s, d, "supplier").select(
        F.concat(F.lit("m"), k.cast("string")).alias("model_name"), F.lit("Co").alias("model_company"),
        F.lit("Svc").alias("service"), F.when(k % 2 == 0, "0.5").alias("temp_key"),
        F.when(k % 3 == 0, "on").alias("thinking"),
    ).distinct()
    return scoring.workload(languages, sentences, entries)


def workload(s, d):
    return _work(s, d).groupBy("language", "sentence_category", "tested_entry").agg(
        F.count("*").alias("n"), F.min("sentence").alias("first_sentence"),
    )


def cache_keys(s, d):
    x = F.col
    e = tx.entry_id(
        x("source"), F.lit("Co"), F.lit("Svc"), F.when(x("doc_id") % 2 == 0, 0.5), F.lit(None).cast("string"),
    )
    return table(s, d, "documents").select(
        "doc_id", tx.translation_key(F.lit("English"), x("lang"), e, x("text")).alias("translation_key"),
        tx.comparison_key(x("text"), F.lit("jA")).alias("comparison_key"),
        tx.coin_flip_key(x("lang"), x("source"), x("text"), F.lit("jA"), F.lit("m1"), F.lit("m2")).alias("coin_key"),
        tx.coherence_key(x("text"), F.lit("jA"), F.lit(0.5)).alias("coherence_key"),
    )


def prompts(s, d):
    r = table(s, d, "region").join(
        table(s, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey"),
    ).groupBy("r_name").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    ask = tx.fill_prompt(
        "Translate from {source} into {target}.\nText: `{text}`", source=F.lit("English"), target=F.col("r_name"),
        text=F.element_at("names", 1),
    )
    return r.select("r_name", ask.alias("translate"), tx.numbered_blocks(F.col("names")).alias("blocks"))


def json_cache_probe(s, d):
    e = table(s, d, "events").select(
        F.col("event_type").alias("entry_id"), F.lit("English").alias("source_lang"),
        F.when(F.col("user_id") % 2 == 0, "German").otherwise("French").alias("target_lang"),
        (F.col("user_id") % 50).cast("string").alias("text"),
        F.when(F.col("user_id") % 3 > 0, F.col("user_id") % 3 / 2.0).alias("temperature"), "event_id",
    )
    on = ["entry_id", "source_lang", "target_lang", "text", "temperature"]
    written = e.withColumn(
        "text", (F.col("text").cast("int") * 2 % 50).cast("string"),
    ).withColumnRenamed("event_id", "seq")
    cached = written.groupBy(*on).agg(F.max("seq").cast("string").alias("response"))
    got = cache.probe_json(e.select(*on), cached)
    return got.groupBy("entry_id", F.col("temperature").isNull().alias("no_temperature")).agg(
        F.count("*").alias("n"), F.count("response").alias("hits"), F.count_distinct("response").alias("responses"),
    )


def cached_inference(s, d):
    asked = table(s, d, "nation").select(
        F.concat(F.lit("k"), F.col("n_regionkey").cast("string")).alias("key"),
        F.concat(F.lit("prompt "), F.col("n_regionkey").cast("string")).alias("prompt"),
        F.lit(0.5).alias("temperature"), "n_name",
    )
    known = s.createDataFrame([("k1", "known")], "key string, value string")
    done, _ = providers.through_cache(asked, known, providers.OfflineProvider)
    return done.select("n_name", "key", "value")


def score_facts(s, d):
    """Parsed scores of blind ids, fanned out to the systems that gave a text, and a -483 row for each refusal.

    Every text is judged: its id is its place among the texts of its sentence, its score follows from the id. j1 reads
    even sentences only, and no response is read where every text was refused."""
    t = fixtures.translations(s, d).withColumn("sentence", F.col("sentence_id").cast("string"))
    judges = s.range(2).select(F.concat(F.lit("j"), F.col("id").cast("string")).alias("judge"))
    place = F.row_number().over(Window.partitionBy("language", "sentence").orderBy(F.md5("translation"))) - 1
    texts = scores.same_texts(t).withColumn("sentence", F.col("sentence_id").cast("string")).select(
        "language", "sentence", "translation", "entries",
    ).withColumn("id", place)
    blind = texts.crossJoin(F.broadcast(judges))
    listed = texts.groupBy("language", "sentence").agg(F.max("id").alias("last")).crossJoin(F.broadcast(judges))
    reads = (F.col("judge") == "j0") | (F.col("sentence").cast("int") % 2 == 0)
    given = F.transform(
        F.sequence(F.lit(0), F.col("last")), lambda i: F.struct(i.alias("id"), (i % 101).cast("double").alias("score")),
    )
    judged = listed.select("language", "sentence", "judge", F.when(reads, given).alias("scores"))
    translated = t.withColumn("translation", F.when(~F.col("refused"), F.col("translation")))
    got = scoring.score_facts(translated, blind, judged, judges)
    return got.groupBy("language", "judge", "tested_entry").agg(
        F.count("*").alias("n"), F.sum("score").alias("total"),
        F.count_if(F.col("translation").isNull()).alias("refused"),
    )


def summary_of_some(s, d):
    return scores.summary(fixtures.rank_items(s, d), ["A", "N"], ["1-URGENT", "2-HIGH"])


def coherence_of_some(s, d):
    return coh.by_depth(fixtures.coherence(s, d), ["A", "N"])


def coherence_of_listed(s, d):
    listed = s.createDataFrame([("m1",), ("m3",), ("m99",)], "tested_entry string")
    return coh.by_category(fixtures.coherence(s, d), 1, listed)


def coherence_extent(s, d):
    return coh.max_depth(fixtures.coherence(s, d))


def dense_ids(s, d):
    pairs = table(s, d, "orders").select(
        F.col("o_orderkey").alias("pos"),
        F.concat(F.lit("m"), (F.col("o_custkey") % 23).cast("string")).alias("entry_a"),
        F.concat(F.lit("m"), (F.col("o_custkey") % 29).cast("string")).alias("entry_b"),
    )
    return pairing.dense_ids(pairs)


def _fixed_fit(s, d):
    """A fit of six systems made of the suppliers: theta by their number and last key, unit variances, covariances 0.25."""
    i, k = F.col("i"), F.col("s_suppkey")
    cov = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda j: F.when(j == i, 1.0).otherwise(0.25))
    made = table(s, d, "supplier").groupBy((k % 6).cast("int").alias("i")).agg(
        ((F.col("i") + F.count("*") % 5 + F.max(k) % 3) / 3.0).alias("theta")
    )
    return made.select(
        "i", "theta", F.exp("theta").alias("strength"), F.lit(0.75).alias("tie"), cov.alias("cov"),
        F.lit(True).alias("converged"),
    )


def interval_formula(s, d):
    return dv.intervals(_fixed_fit(s, d)).select("i", "low", "mid", "high", "conf_level").unionByName(
        dv.intervals(_fixed_fit(s, d), 0.5).select("i", "low", "mid", "high", "conf_level")
    )


def wald_p_values(s, d):
    return dv.p_values(_fixed_fit(s, d)).drop("converged")


def leaderboard_places(s, d):
    return dv.leaderboard(_fixed_fit(s, d)).select("i", "rank", "mid", F.to_json("p_vals").alias("p_vals")).join(
        dv.ordinal_ranks(_fixed_fit(s, d)).select("i", "place"), "i",
    )


def correlation_formula(s, d):
    """Ten systems, as strong as their suppliers' and their customers' highest balances say."""
    overall = table(s, d, "supplier").groupBy(
        (F.col("s_suppkey") % 10).cast("int").alias("i")
    ).agg(F.max("s_acctbal").alias("strength"))
    judged = table(s, d, "customer").groupBy(
        (F.col("c_custkey") % 12).cast("int").alias("i"), F.col("c_mktsegment").alias("evaluating_model"),
    ).agg(F.max("c_acctbal").alias("strength"))
    return dv.correlations(overall, judged)


def log_likelihood(s, d):
    return dv.log_likelihood(
        pairwise.pair_counts(fixtures.comparisons(s, d), "language"),
        s.range(8).select(
            F.col("id").cast("int").alias("i"), (F.col("id") + 1.0).alias("strength"), F.lit(0.75).alias("tie"),
        ),
        "language",
    )


def round_trips(s, d):
    sentences = table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("sentence"))
    there = lambda x: x.withColumn("text", F.md5(F.concat(F.lit(">"), "text")))
    back = lambda x: x.withColumn(
        "text", F.when(~F.col("text").startswith("0"), F.md5(F.concat(F.lit("<"), "text"))),
    )
    return active.round_trips(sentences, 3, there, back).select("doc_id", "depth", "text")


QUERIES = {f.__name__: f for f in (
    refusal_rules, target_languages, language_support, workload, cache_keys, prompts, json_cache_probe,
    cached_inference, score_facts, summary_of_some, coherence_of_some, coherence_of_listed, coherence_extent, dense_ids,
    interval_formula, wald_p_values, leaderboard_places, correlation_formula, log_likelihood, round_trips,
)}


def _sql(v) -> str:
    return "NULL" if v is None else f"'{v}'"


_CODES = ", ".join(f"({', '.join(map(_sql, x))})" for x in providers.LANGUAGES)


_FIT = """fit AS (SELECT (s_suppkey % 6)::INT AS i, (any_value(s_suppkey % 6) + count(*) % 5 + max(s_suppkey) % 3) / 3 AS theta
  FROM supplier GROUP BY 1)"""
_FIT_Z = """zs AS (SELECT a.i, b.i AS j, abs(a.theta - b.theta) / sqrt(1.5::DOUBLE) AS z FROM fit a JOIN fit b ON a.i <> b.i)"""


def oracle(rank: str, coherence: str, translations: str, comparisons: str, phi: str) -> dict[str, str]:
    """The SQL; the arguments are the shared definitions of the fact tables and of the normal distribution."""
    return {
        "refusal_rules": r"SELECT lang, count_if(length(text) < 3 OR contains(text, '483'))::BIGINT AS refused, count_if(contains(text, '483'))::BIGINT AS marked, count_if(regexp_replace(text, '^[\s\x0B]+|[\s\x0B]+$', '', 'g') = '')::BIGINT AS blank FROM documents GROUP BY lang",
        "target_languages": f"""WITH c AS (SELECT *, row_number() OVER () - 1 AS k FROM (VALUES {_CODES}) x(language, deepl_code, lingvanex_code)),
q AS (SELECT o_custkey % {len(providers.LANGUAGES)} AS k, count(*) AS n FROM orders GROUP BY 1)
SELECT language, deepl_code, lingvanex_code, CASE WHEN language = 'EuropeanSpanish' THEN 'Spanish'
  ELSE language END AS hybrid_code, coalesce(n, 0) AS n FROM c LEFT JOIN q ON c.k = q.k WHERE language <> 'English'""",
        "language_support": f"""WITH c AS (SELECT *, row_number() OVER () - 1 AS k FROM (VALUES {_CODES}) x(language, deepl_code, lingvanex_code)), q AS (SELECT language AS target, deepl_code, lingvanex_code FROM orders JOIN c ON o_custkey % {len(providers.LANGUAGES)} = k)
SELECT 'deepl_code' AS service, target, count(*) AS n FROM q WHERE deepl_code IS NOT NULL GROUP BY target UNION ALL
  SELECT 'lingvanex_code', target, count(*) FROM q WHERE lingvanex_code IS NOT NULL GROUP BY target UNION ALL
  SELECT 'hybrid_code', target, count(*) FROM q GROUP BY target""",
        "workload": """SELECT r_name AS language, n_regionkey::VARCHAR AS sentence_category, 'm' || k::VARCHAR || 'CoSvc' || CASE WHEN k % 2 = 0 THEN '0.5' ELSE 'None' END || CASE WHEN k % 3 = 0 THEN 'on' ELSE 'None' END AS tested_entry, count(*) AS n, min(n_name) AS first_sentence
FROM region CROSS JOIN nation CROSS JOIN (SELECT DISTINCT s_suppkey % 8 AS k FROM supplier) GROUP BY ALL""",
        "cache_keys": """SELECT doc_id, 'TRANSLATION From Language:English To Language: ' || lang || '|Model: ' || source || 'CoSvc' || CASE WHEN doc_id % 2 = 0 THEN '0.5' ELSE 'None' END || 'None|Sentence md5:' || md5(text) AS translation_key, 'COMPARISON hash:' || md5(text) || ' Model:jA' AS comparison_key,
'COIN FLIP Language:' || lang || '|Sentence cat:' || source || '|Sentence md5:' || md5(text) || '|jA|m1|m2' AS coin_key,
  md5(text) || '|jA|0.5' AS coherence_key FROM documents""",
        "prompts": """WITH x AS (SELECT r_name, n_name, row_number() OVER (PARTITION BY r_name ORDER BY n_name) - 1 AS i FROM region JOIN nation ON n_regionkey = r_regionkey)
SELECT r_name, 'Translate from English into ' || r_name || '.' || chr(10) || 'Text: `' || min(n_name)
  || '`' AS translate, string_agg('Translation ID ' || i::VARCHAR || ':' || chr(10) || '```' || n_name || '```'
  || chr(10), '' ORDER BY i) AS blocks FROM x GROUP BY r_name""",
        "json_cache_probe": """WITH e AS (SELECT event_type AS a, user_id % 2 AS t, user_id % 50 AS x, CASE WHEN user_id % 3 > 0 THEN user_id % 3 END AS m, event_id FROM events),
c AS (SELECT a, t, x * 2 % 50 AS x, m, max(event_id) AS r FROM e GROUP BY ALL)
SELECT e.a AS entry_id, e.m IS NULL AS no_temperature, count(*) AS n, count(r) AS hits, count(DISTINCT r) AS responses
  FROM e LEFT JOIN c ON e.a = c.a AND e.t = c.t AND e.x = c.x AND e.m IS NOT DISTINCT FROM c.m GROUP BY ALL""",
        "cached_inference": """SELECT n_name, 'k' || n_regionkey::VARCHAR AS key, CASE WHEN n_regionkey = 1 THEN 'known' ELSE 'offline:'
  || substr(sha256('0.5|prompt ' || n_regionkey::VARCHAR), 1, 16) END AS value FROM nation""",
        "score_facts": f"""WITH {translations}, j AS (SELECT * FROM (VALUES ('j0'), ('j1')) x(judge)),
x AS (SELECT language, sentence_id, translation, row_number() OVER (PARTITION BY language, sentence_id
  ORDER BY md5(translation)) - 1 AS id FROM (SELECT DISTINCT language, sentence_id, translation FROM tr
  WHERE NOT refused)),
n AS (SELECT language, sentence_id, bool_and(refused) AS silent FROM tr GROUP BY ALL),
f AS (SELECT tr.language, tested_entry, judge, refused, CASE WHEN refused THEN -483::DOUBLE
  ELSE (id % 101)::DOUBLE END AS score FROM tr CROSS JOIN j JOIN n ON n.language = tr.language
  AND n.sentence_id = tr.sentence_id
  LEFT JOIN x ON x.language = tr.language AND x.sentence_id = tr.sentence_id AND x.translation = tr.translation AND NOT refused WHERE judge = 'j0' OR tr.sentence_id % 2 = 0 OR silent)
SELECT language, judge, tested_entry, count(*) AS n, sum(score) AS total, count_if(refused)::BIGINT AS refused FROM f
  GROUP BY ALL""",
        "summary_of_some": f"""WITH {rank}, k AS (SELECT *, row_number() OVER (PARTITION BY tested_entry ORDER BY score) AS rn,
  count(*) OVER (PARTITION BY tested_entry) AS m FROM rank_items WHERE evaluating_model IN ('A', 'N')
  AND sentence_category IN ('1-URGENT', '2-HIGH')) SELECT tested_entry, count(*) AS n, round(avg(score), 6) AS mean,
  max(CASE WHEN rn = m // 2 + 1 THEN score END) AS median, round(stddev_pop(score), 6) AS std,
  count_if(score = -483)::BIGINT AS refusals, round(avg(CASE WHEN score <> -483 THEN score END), 6) AS mean_scored
  FROM k GROUP BY tested_entry""",
        "coherence_of_some": f"""WITH {coherence}, s AS (SELECT * FROM it WHERE sentence_cat IN ('A', 'N')) SELECT tested_entry, depth,
  round(avg(m), 6) AS coherence FROM s GROUP BY ALL UNION ALL SELECT DISTINCT tested_entry, 0, 100.0::DOUBLE FROM s""",
        "coherence_of_listed": f"""WITH {coherence}, s AS (SELECT * FROM (VALUES ('m1'), ('m3'), ('m99')) x(tested_entry)), a AS (SELECT it.* FROM it
  JOIN s ON it.tested_entry = s.tested_entry WHERE depth = 1) SELECT s.tested_entry, c.sentence_cat,
  round(coalesce(avg(m), 0), 6) AS coherence FROM s CROSS JOIN (SELECT DISTINCT sentence_cat FROM a) c LEFT
  JOIN a ON a.tested_entry = s.tested_entry AND a.sentence_cat = c.sentence_cat GROUP BY ALL""",
        "coherence_extent": f"""WITH {coherence} SELECT max(depth) AS max_depth, count(DISTINCT tested_entry) AS systems FROM coh""",
        "dense_ids": """WITH x AS (SELECT 'm' || (o_custkey % 23)::VARCHAR AS entry, 2 * o_orderkey AS p FROM orders UNION ALL SELECT 'm'
  || (o_custkey % 29)::VARCHAR, 2 * o_orderkey + 1 FROM orders), y AS (SELECT entry, min(p) AS p FROM x GROUP BY entry)
  SELECT entry, (row_number() OVER (ORDER BY p) - 1)::INT AS id FROM y""",
        "interval_formula": f"""WITH {_FIT} SELECT i, round(exp(theta - z), 4) AS low, round(exp(theta), 4) AS mid, round(exp(theta + z), 4) AS high,
  c AS conf_level FROM fit CROSS JOIN (VALUES (0.95::DOUBLE, 1.959963984540054::DOUBLE),
  (0.5::DOUBLE, 0.6744897501960817::DOUBLE)) l(c, z)""",
        "wald_p_values": f"WITH {_FIT}, {_FIT_Z}, {phi} SELECT i, j, round(least(1, 2 * tail), 4) AS p FROM phi",
        "leaderboard_places": f"""WITH {_FIT}, {_FIT_Z}, {phi}, r AS (SELECT *, row_number() OVER (ORDER BY theta DESC, i)::INT AS rank FROM fit)
SELECT r.i, rank, round(exp(theta), 4) AS mid, '{{' || string_agg('"' || j::VARCHAR || '":'
  || round(least(1, 2 * tail), 4)::VARCHAR, ',' ORDER BY j) || '}}' AS p_vals, (rank - 1)::INT AS place FROM phi
  JOIN r ON phi.i = r.i GROUP BY r.i, rank, theta""",
        "correlation_formula": """WITH b AS (SELECT (s_suppkey % 10)::INT AS i, max(s_acctbal) AS s FROM supplier GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY s DESC, i) - 1 AS r FROM b),
j AS (SELECT (c_custkey % 12)::INT AS i, c_mktsegment AS evaluating_model, max(c_acctbal) AS s FROM customer
  GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY evaluating_model ORDER BY s DESC, i) - 1 AS r FROM j)
SELECT evaluating_model, CASE WHEN count(DISTINCT p.s) > 1 AND count(DISTINCT o.s) > 1 THEN round(corr(p.s,
  o.s), 6) END AS pearson, CASE WHEN count(DISTINCT p.r) > 1 AND count(DISTINCT o.r) > 1 THEN round(corr(p.r,
  o.r), 6) END AS spearman, count(*) AS n FROM p JOIN o ON p.i = o.i GROUP BY evaluating_model""",
        "log_likelihood": f"""WITH {comparisons}, c AS (SELECT language, a_id + 1 AS i, b_id + 1 AS j, count_if(vote = 'win_a') AS w, count_if(vote = 'win_b') AS l, count_if(vote = 'tie') AS t, 0.75::DOUBLE * sqrt((a_id + 1) * (b_id + 1)) AS e FROM votes WHERE vote IS NOT NULL GROUP BY language, a_id, b_id)
SELECT language,
  round(sum(w * ln(i / (i + j + e)) + l * ln(j / (i + j + e)) + t * ln(e / (i + j + e))), 4) AS log_likelihood FROM c
  GROUP BY language""",
        "round_trips": """WITH RECURSIVE r AS (SELECT doc_id, 0 AS depth, coalesce(text, '') AS text FROM documents UNION ALL SELECT doc_id, depth + 1, md5('<' || md5('>' || text)) FROM r WHERE depth < 3 AND NOT starts_with(md5('>' || text), '0'))
SELECT doc_id, depth, text FROM r WHERE depth > 0""",
    }
