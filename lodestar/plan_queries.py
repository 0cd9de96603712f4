"""Queries of the plans, connectors, lists and reports, and the SQL that gives the same rows.

Providers are offline ones whose answers follow from the digest of what they are asked, so SQL can say them too.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import coherence as coh
from .operators import charts, pairwise, reports, scores
from .operators import davidson as dv
from .plans import active, coherence, scoring
from .plans import pairwise as pairwise_plan_of
from .sources import cache, fixtures, latency, lists, providers, services, sinks
from .sources.shared import settle, shared_dir
from .streaming.board import Steps
from .streaming.latency import replace_windows, windowed

table = fixtures.table


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class DigestProvider:
    """Translates and judges by the digest of what it is asked; some answers are refusals, some calls fail."""

    def translate(self, source: str, target: str, text: str, temperature: float | None) -> str:
        h = _sha(f"{source}>{target}|{temperature}|{text}")
        if h[0] == "1":
            raise RuntimeError("no answer")
        return "483" if h[0] == "0" else h[:12]

    def infer(self, prompt: str, temperature: float | None) -> str:
        h = _sha(prompt)
        n = prompt.count("Translation ID ")
        if n:  # scores of a list
            return "terse\n```json\n" + json.dumps(
                [{"id": f"ID {i}", "score": str((17 * i + 3) % 101)} for i in range(n)]
            ) + "\n```"
        if prompt.startswith("Rate"):
            return f"thoughts\n{int(h[:2], 16) % 120}"
        if h[0] == "f":
            raise RuntimeError("no answer")
        return "A better at x\n" + [
            "Translation A", "Translation B", "Identical", "Translation A or Translation B",
        ]["012345".find(h[0]) < 0 and 1 + ("6789ab".find(h[0]) < 0) + (h[0] == "e")]

    def is_tl_valid(self, target: str) -> bool:
        return True


def _no_cache(s: SparkSession) -> DataFrame:
    return s.createDataFrame([], "key string, value string")


# connectors


def _asked(s, d):
    names = F.array(*[F.lit(x[0]) for x in providers.LANGUAGES])
    k = F.col("n_nationkey")
    return table(s, d, "nation").select(
        F.col("n_name").alias("key"), F.lit("English").alias("source"),
        F.element_at(names, (k % len(providers.LANGUAGES) + 1).cast("int")).alias("target"),
        F.concat(F.lit("say "), "n_name").alias("text"),
        F.concat(F.lit('say "'), "n_name", F.lit('"\nnow')).alias("prompt"),
        F.concat(F.lit("m"), (k % 3).cast("string")).alias("model"),
        F.when(k % 4 > 0, (k % 4) / 2.0).alias("temperature"), (k % 2 == 0).alias("thinking"),
    )


def connector_requests(s, d):
    """What would be sent to each service for each nation; no body where the service lacks the language."""
    codes = providers.languages(s)
    of = lambda kind, known: [
        services.requests(
            services.with_codes(_asked(s, d), codes, x), x, "" if kind == "translate" else "Be terse. ",
        ).select(F.lit(kind).alias("kind"), F.lit(x.name).alias("service"), "key", "url", "body") for x in known.values()
    ]
    return fixtures.union_all(of("translate", services.TRANSLATORS) + of("judge", services.JUDGES))


#: Recorded replies: service, reply around the text {t}.
REPLIES = {
    "openrouter": '{"choices":[{"message":{"content":"{t}"}}]}',
    "groq": '{"choices":[{"message":{"content":"{t}"}},{"message":{"content":"x"}}]}',
    "mistral": '{"choices":[{"message":{"content":"{t}"}}]}',
    "anthropic": '{"content":[{"type":"text","text":"{t}"}]}', "cohere": '{"generations":[{"text":" {t} \\n"}]}',
    "deepl": '{"translations":[{"text":"{t}"}]}',
    "google": '{"candidates":[{"content":{"parts":[{"text":"{t}"}]}}]}', "lingvanex": '{"err":null,"result":"{t}"}',
    "hybrid": '{"translations":[{"combined":false,"text":"x"},{"combined":true,"text":"{t}"}]}',
}


def connector_replies(s, d):
    """Recorded replies read: every fourth has status 500, every fifth is empty, every seventh of one service an error."""
    k = F.col("n_nationkey")
    rows = table(s, d, "nation").withColumn("status", F.when(k % 4 == 0, 500).otherwise(200))

    def read(name, reply):
        body = F.replace(F.lit(reply), F.lit("{t}"), F.col("n_name"))
        body = F.when(k % 5 == 0, "{}").when(
            (k % 7 == 0) & F.lit(name == "lingvanex"), '{"err":"quota","result":null}',
        ).otherwise(body)
        text, error = services.answer(services.TRANSLATORS[name], F.col("status"), body)
        return rows.select(
            F.lit(name).alias("service"), F.col("n_name").alias("key"), text.alias("value"), error.alias("error"),
        )

    return fixtures.union_all([read(*x) for x in REPLIES.items()])


# lists


def entry_lists(s, d):
    k = F.col("s_suppkey")
    rows = table(s, d, "supplier").select(
        F.concat(F.lit("list"), F.col("s_nationkey").cast("string")).alias("list_name"), k.cast("int").alias("pos"),
        F.col("s_name").alias("model_name"), F.lit("Co").alias("model_company"),
        F.lit("openrouter").alias("service"), F.lit("m").alias("model"),
        F.when(k % 3 > 0, F.when(k % 3 == 1, "0").otherwise("0.33")).alias("temp"),
        F.when(k % 2 == 0, "N/A").alias("thinking"),
    )
    return lists.entries(rows).select(
        "list_name", "pos", "tested_entry", "temperature", F.to_json(lists.entry_struct()).alias("model"),
    )


def judge_registry(s, d):
    k = F.col("c_custkey")
    rows = table(s, d, "customer").select(
        k.cast("int").alias("pos"), F.concat(F.lit("judge"), (k % 23).cast("string")).alias("judge"),
        F.lit("openrouter").alias("service"), F.concat(F.lit("m"), k.cast("string")).alias("model"),
        F.when(k % 2 == 0, "p").alias("prefix"),
    )
    return lists.judges(rows)


def sentence_corpus(s, d):
    rows = table(s, d, "region").join(
        table(s, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey"),
    ).groupBy("r_name", "r_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("sentences"))
    return lists.sentences(
        rows.select(F.col("r_name").alias("category"), F.col("r_regionkey").alias("category_pos"), "sentences")
    )


def json_cache_write(s, d):
    e = table(s, d, "events").select(
        F.concat(F.lit("m"), (F.col("user_id") % 90).cast("string")).alias("entry_id"),
        F.lit("English").alias("source_lang"), F.col("event_type").alias("target_lang"), F.col("props").alias("text"),
        F.when(F.col("event_id") % 3 > 0, 0.5).alias("temperature"), F.col("event_id").cast("string").alias("response"),
        F.col("event_id").alias("seq"),
    )
    first = cache.upsert_json(s.createDataFrame([], cache.JSON_SCHEMA), e.where("seq % 2 = 1"))
    return cache.upsert_json(first, e.where("seq % 2 = 0"))


# two systems: every figure of the model has a closed form


def _duels(s, d):
    """The comparisons as of two systems, four of the eight each, first and second exchanged on odd sentences; what was
    between systems of one side is a pair of a system with itself, and goes."""
    odd = F.col("sentence").cast("long") % 2 == 1
    side = lambda x: F.floor(F.col(f"{x}_id") / 4).cast("int")
    turned = lambda x, y: F.when(odd, y).otherwise(x)
    rows = fixtures.comparisons(s, d).select(
        "language", turned(side("a"), side("b")).alias("a_id"), turned(side("b"), side("a")).alias("b_id"), "sentence",
        "sentence_category", "evaluating_model",
        turned(F.col("a_success"), F.col("b_success")).alias("a_success"),
        turned(F.col("b_success"), F.col("a_success")).alias("b_success"), "identical",
    )
    return pairwise.without_self_pairs(rows)


def _sides(s):
    model = F.struct(
        F.concat(F.lit("side "), F.col("id").cast("string")).alias("model_name"),
        F.when(F.col("id") == 1, 0.5).alias("temp"),
    )
    return s.range(2).select(F.col("id").cast("int").alias("i"), model.alias("model"))


def duel_fit(s, d):
    f = dv.intervals(dv.fit(pairwise.pair_counts(_duels(s, d), "language"), 2, "language"))
    return f.select(
        "language", "i", *[F.round(c, 6).alias(c) for c in ("theta", "strength", "tie")],
        F.round("log_likelihood", 3).alias("log_likelihood"), "low", "mid", "high", "conf_level", "converged",
    )


def duel_from_outcomes(s, d):
    """The same strengths from single outcomes, the search starting elsewhere."""
    won = F.when(F.col("a_success"), "win1").when(F.col("b_success"), "win2").when(F.col("identical"), "tie")
    rows = _duels(s, d).select(
        "language", F.col("a_id").alias("i"), F.col("b_id").alias("j"), won.alias("result"),
    ).where("result is not null")
    f = dv.from_comparisons(rows, 2, "language", strengths=[0.9, 0.1], tie=3.0)
    return f.select("language", "i", *[F.round(c, 6).alias(c) for c in ("strength", "tie")])


def _duel_records(s, d):
    return dv.records(
        dv.leaderboard(dv.fit(pairwise.pair_counts(_duels(s, d), "language"), 2, "language"), "language"), _sides(s),
        "language",
    )


def duel_leaderboard(s, d):
    return _duel_records(s, d).select(
        "language", "position", F.to_json("model").alias("model"), "model_id",
        F.to_json("intervals").alias("intervals"), F.to_json("p_vals").alias("p_vals"), "rank",
    )


def leaderboard_report(s, d):
    return reports.leaderboard(_duel_records(s, d), "language")


def strengths_ranked(s, d):
    return dv.strengths_by_rank(
        dv.fit(pairwise.pair_counts(_duels(s, d), "language"), 2, "language"), _sides(s), "language",
    ).select("language", "rank", "i", "model.model_name", F.round("strength", 6).alias("strength"))


def duel_categories(s, d):
    return dv.category_signal(_duels(s, d), 2, least_systems=2).withColumns(
        {c: F.round(c, 6) for c in ("spread", "width", "significant")}
    ).drop("n")


def category_report(s, d):
    return reports.categories(dv.category_signal(_duels(s, d), 2, least_systems=2, in_turn=True))


def _judge_analysis(s, d):
    judges = s.createDataFrame([("jA",), ("jB",), ("jC",), ("jZ",)], "judge string")
    return dv.judge_analysis(_duels(s, d), judges, 2)


def duel_judges(s, d):
    return _judge_analysis(s, d)


def judge_report(s, d):
    return reports.judges(_judge_analysis(s, d))


def comparison_progress(s, d):
    return pairwise.progress(fixtures.comparisons(s, d), 1_000_000)


def score_counts(s, d):
    return scores.score_counts(fixtures.rank_items(s, d))


def mannwhitney_exact(s, d):
    """Regions with five untied values each: small enough for the exact test."""
    rows = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return scores.mann_whitney(
        rows.select(F.col("r_name").alias("tested_entry"), F.col("n_nationkey").cast("double").alias("score"))
    )


# plans


def _translations(s, d):
    """A text of four systems for every part: refusals, equal texts and others."""
    k, p = F.col("id"), F.col("p_partkey")
    refused = (p + k * 3) % 7 == 0
    text = F.when(refused, "483").otherwise(
        F.concat(F.lit(" t"), ((F.col("p_size") * (k + 1)) % 5).cast("string"), F.when(k % 2 == 0, "\n").otherwise(""))
    )
    return table(s, d, "part").crossJoin(F.broadcast(s.range(4))).select(
        F.lit("German").alias("language"), F.concat(F.col("p_name"), F.lit(" "), p.cast("string")).alias("sentence"), F.col("p_brand").alias("sentence_category"), k.cast("int").alias("id"), text.alias("text")
    )


def _pairwise(s, d):
    chosen = s.createDataFrame([(a, b) for a in range(4) for b in range(a + 1, 4)], "a_id int, b_id int")
    return pairwise_plan_of.compare(
        pairwise_plan_of.pairs(_translations(s, d), chosen), s.createDataFrame([("j1",), ("j2",)], "judge string"),
        _no_cache(s), DigestProvider,
    )


def pairwise_plan(s, d):
    """Comparison facts of four systems on every part, judged offline."""
    f = _pairwise(s, d)[0]
    return f.groupBy("sentence_category", "a_id", "b_id", "evaluating_model").agg(
        F.count("*").alias("n"), F.count_if("a_success").alias("a"), F.count_if("b_success").alias("b"), F.count_if("identical").alias("t"), F.count_if(F.col("evaluating_response") == "Autoskipped").alias("auto")
    )


def pairwise_cache(s, d):
    """What a run adds to the cache: prompts that gave a verdict, each once."""
    f, calls = _pairwise(s, d)
    return pairwise_plan_of.readable(calls, f).groupBy(tx.last_line(F.col("value")).alias("verdict")).agg(
        F.count("*").alias("n"), F.count_distinct("key").alias("keys"),
    )


def _scoring_work(s, d):
    sentences = table(s, d, "nation").select(
        F.col("n_regionkey").cast("string").alias("sentence_category"), F.col("n_name").alias("sentence"),
    )
    entries = s.createDataFrame(
        [
            ("m0", "c", "s", "0", None), ("m1", "c", "s", "0", "on"), ("m2", "c", "s", "1", None),
            ("m3", "c", "s", None, None),
        ],
        "model_name string, model_company string, service string, temp_key string, thinking string",
    )
    return scoring.workload(s.createDataFrame([("German",), ("French",)], "language string"), sentences, entries)


def scoring_plan(s, d):
    """Scores of four systems on every nation's name: translated, listed blind, judged and refused offline."""
    judges = s.createDataFrame([("j1",), ("j2",)], "judge string")
    done, _ = scoring.translate(_scoring_work(s, d), _no_cache(s), DigestProvider)
    blind = scoring.blind_lists(done, judges)
    judged, _ = scoring.judge(blind, _no_cache(s), DigestProvider)
    return scoring.score_facts(done, blind, judged, judges).select(
        "language", "sentence", "judge", "tested_entry", "translation", "score",
    )


def scoring_prompts(s, d):
    """The prompts of the scoring plan, whole, by their digests."""
    done, _ = scoring.translate(_scoring_work(s, d), _no_cache(s), DigestProvider)
    blind = scoring.blind_lists(done, s.createDataFrame([("j1",), ("j2",)], "judge string"))
    return scoring.prompts(blind).select(
        "language", "sentence", "judge", F.length("prompt").alias("length"),
        F.sha2("prompt", 256).alias("prompt_sha256"), "key",
    )


def translation_log(s, d):
    """Per system and category: calls that gave a text, and calls that never did."""
    work = _scoring_work(s, d)
    done, calls = scoring.translate(work, _no_cache(s), DigestProvider)
    asked = done.select(
        "key", F.col("tested_entry").alias("model_id"), F.col("sentence_category").alias("sentence_cat"), "sentence",
    )
    logged = scoring.latency_log(asked, calls).groupBy("model_id", "sentence_cat").agg(
        F.count("*").alias("logged"), F.count_if(F.col("duration") >= 0).alias("timed"),
    )
    failed = asked.join(scoring.failures(calls), "key").groupBy("model_id", "sentence_cat").agg(
        F.count("*").alias("failed"), F.max("attempts").alias("attempts"),
    )
    return logged.join(failed, ["model_id", "sentence_cat"], "full").na.fill(0)


def _coherence(s, d):
    sentences = table(s, d, "nation").select(
        F.col("n_regionkey").cast("string").alias("sentence_category"), F.col("n_nationkey").alias("sentence_pos"),
        F.col("n_name").alias("sentence"),
    )
    entries = s.createDataFrame([("m0", 0.0), ("m1", 1.0), ("m2", None)], "tested_entry string, temperature double")
    work = coherence.tasks(entries, sentences, first=4)
    return coherence.batch(
        work, s.createDataFrame([("e1",), ("e2",)], "judge string"), "German", 3, _no_cache(s), DigestProvider,
        DigestProvider,
    )[0]


def coherence_plan(s, d):
    """Round trips of three systems on the first four names of each region, rated at every depth."""
    return _coherence(s, d)


def coherence_nested(s, d):
    return coherence.nested(_coherence(s, d)).withColumn("evaluations", F.to_json("evaluations"))


def coherence_chart(s, d):
    """The chart of the coherence facts, read back: whether each point stands where its mean belongs."""
    means, path = settle(coh.by_depth(fixtures.coherence(s, d))), _path(s, "chart") + ".svg"
    sinks.write_text(s, charts.by_depth(means), path)
    lines = _names_of(s, path).withColumn("points", F.element_at(_all("points", r'points="([^"]*)"'), F.col("k") + 1))
    drawn = lines.select("tested_entry", F.posexplode(F.split("points", " ")).alias("depth", "p"))
    y = F.split("p", ",")[1].cast("double")
    return drawn.join(means, ["tested_entry", "depth"], "full").select(
        "tested_entry", "depth", F.coalesce(F.abs(_share(y) - F.col("coherence")) < 0.01, F.lit(False)).alias("placed"),
    )


def _all(name: str, pattern: str) -> F.Column:
    return F.regexp_extract_all("value", F.lit(pattern), F.lit(1)).alias(name)


def _share(y: F.Column) -> F.Column:
    """The value, in percent, that stands at a height of a chart."""
    return (charts.HEIGHT - charts.EDGE - y) / (charts.HEIGHT - 2 * charts.EDGE) * 100


def _names_of(s, path):
    """The systems of a chart's legend with their number k, and the chart's text."""
    legend = _all("names", rf'<text x="{charts.WIDTH - 134}"[^>]*>([^<]*)</text>')
    return s.read.text(path, wholetext=True).select("value", F.posexplode(legend).alias("k", "tested_entry"))


def overlapped_calls(s, d):
    """A rating of every part, eight calls of a task at once."""
    asked = table(s, d, "part").select(
        F.col("p_partkey").cast("string").alias("key"), F.concat(F.lit("Rate "), "p_name").alias("prompt"),
        F.lit(0.0).alias("temperature"),
    )
    return providers.call(asked, DigestProvider, at_once=8).select("key", "value", "attempts")


def sampled_order(s, d):
    """The blind order of stored judgements: the texts of every sentence and language in the order that the standard
    library's generator draws."""
    t = fixtures.translations(s, d).where("not refused").select(
        "language", F.col("sentence_id").cast("string").alias("sentence"), F.lit("c").alias("sentence_category"),
        F.md5("translation").alias("translation"), "tested_entry",
    )
    judges = s.createDataFrame([("jA",), ("jB",)], "judge string")
    return scoring.blind_lists(t, judges, sampled=True).select(
        "language", "sentence", "judge", "id", "translation", F.array_join("entries", ",").alias("entries"),
    )


def category_chart(s, d):
    """The bar chart of coherence by category, written and read back: whether each bar is as high as its mean."""
    means, path = settle(coh.by_category(fixtures.coherence(s, d), 2)), _path(s, "chart") + ".svg"
    sinks.write_text(s, charts.by_category(means), path)
    named = _names_of(s, path)
    titles = rf'<text x="[^"]*" y="{charts.HEIGHT - charts.EDGE + 18}"[^>]*>([^<]*)</text>'
    bars = r'<rect x="[^"]*" y="[^"]*" width="[^"]*" height="([^"]*)"'
    systems = named.groupBy("value").agg(F.count("*").alias("systems"))
    every = systems.select("systems", _all("titles", titles), F.posexplode(_all("bars", bars)).alias("at", "height"))
    of = every.where(F.col("at") < F.col("systems") * F.size("titles")).select(  # the legend's marks come last
        F.element_at("titles", (F.floor(F.col("at") / F.col("systems")) + 1).cast("int")).alias("sentence_cat"),
        (F.col("at") % F.col("systems")).alias("k"), F.col("height").cast("double").alias("height"),
    )
    value = F.col("height") / (charts.HEIGHT - 2 * charts.EDGE) * 100
    drawn = of.join(named.select("k", "tested_entry"), "k")
    return drawn.join(means, ["tested_entry", "sentence_cat"], "full").select(
        "tested_entry", "sentence_cat", F.coalesce(F.abs(value - F.col("coherence")) < 0.05, F.lit(False)).alias("placed"),
    )


def active_learning(s, d):
    """Four systems, compared at first with their neighbours only; every round adds the most uncertain pair's comparisons,
    until none is left."""
    side = lambda x: F.floor(F.col(f"{x}_id") / 2).cast("int").alias(f"{x}_id")
    known = fixtures.comparisons(s, d)
    known = settle(pairwise.without_self_pairs(known.select("language", side("a"), side("b"), *known.columns[3:])))
    compare = lambda chosen: known.join(
        F.broadcast(chosen.select("language", F.col("i").alias("a_id"), F.col("j").alias("b_id"))),
        ["language", "a_id", "b_id"],
    )
    out, _ = active.learn(known.where("b_id - a_id = 1"), 4, compare, threshold=0.0)
    return out.groupBy("language", "a_id", "b_id").agg(F.count("*").alias("n"))


def latency_stream(s, d):
    """The log as a stream: windows of an hour over all events, in the order that a stream reads them."""
    schema = table(s, d, "events").schema
    log = s.readStream.schema(schema).parquet(f"{d}/events.parque[t]").select(
        F.concat(F.lit("m"), (F.col("user_id") % 8).cast("string")).alias("model_id"), F.col("value").alias("duration"),
        F.col("ts").cast("timestamp").alias("logged_at"),
    )
    path = _path(s, "windows")
    replace_windows(windowed(log, "1 hour"), path, _path(s, "progress"), availableNow=True).awaitTermination()
    return Steps(s, path).last().select(F.col("start").cast("timestamp_ntz").alias("start"), "model_id", "n", "total")


# round trips through files


def _path(s: SparkSession, name: str) -> str:
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


def latency_file(s, d):
    """The log appended to in two goes, read back and summed up."""
    path, rows = _path(s, "latency"), fixtures.latency(s, d).withColumn(
        "logged_at", F.unix_micros(F.col("logged_at").cast("timestamp")) / 1e6,
    )
    for part in (F.col("duration") < 50, F.col("duration") >= 50):
        latency.append(rows.where(part), path)
    return latency.summary(latency.read(s, path))


def kv_table(s, d):
    """A cache on disk: set twice, keys deleted, read back; of repeated keys the last event counts."""
    table_of = cache.KVTable(s, _path(s, "kv"))
    e = table(s, d, "events").select(
        F.concat(F.lit("u"), (F.col("user_id") % 70).cast("string")).alias("key"), F.col("event_type").alias("value"),
        F.col("event_id").alias("seq"),
    )
    table_of.set(e.where("value <> 'click'"))
    table_of.set(e.where("value = 'click'"))
    table_of.delete(e.select("key").where("key like '%7'").distinct())
    return table_of.read().select("key", "value")


def json_cache_file(s, d):
    """The JSON cache written twice and read back."""
    path = _path(s, "json")
    e = table(s, d, "events").select(
        F.concat(F.lit("m"), (F.col("user_id") % 90).cast("string")).alias("entry_id"),
        F.lit("English").alias("source_lang"), F.col("event_type").alias("target_lang"), F.col("props").alias("text"),
        F.when(F.col("event_id") % 3 > 0, 0.5).alias("temperature"), F.col("event_id").cast("string").alias("response"),
        F.col("event_id").alias("seq"),
    )
    cache.write_json_cache(s, path, e.where("seq % 2 = 1"))
    cache.write_json_cache(s, path, e.where("seq % 2 = 0"))
    return cache.read_json_cache(s, path)


def document_file(s, d):
    """The nested document written as JSON and read back, counted by system."""
    path, items = _path(s, "document"), fixtures.rank_items(s, d)
    document = scores.document(
        items,
        items.select("tested_entry").distinct().withColumn("model", F.struct(F.col("tested_entry").alias("name"))),
    )
    sinks.write_document(document, path)
    rows = s.read.schema(document.schema).json(path).select("language", F.explode("models").alias("m")).select(
        "language", "m.model.name", F.explode("m.comparison_items").alias("c"),
    )
    return rows.groupBy("language", "name").agg(
        F.count("*").alias("groups"), F.sum(F.size("c.scores")).alias("scores"),
        F.round(F.sum(F.aggregate("c.scores", F.lit(0.0), lambda a, x: a + x)), 2).alias("total"),
    )


def list_files(s, d):
    """Systems and sentences written as files and loaded by their readers."""
    path = _path(s, "entries")
    table(s, d, "supplier").select(
        F.lit("all").alias("list_name"), F.col("s_suppkey").cast("int").alias("pos"),
        F.col("s_name").alias("model_name"), F.lit("Co").alias("model_company"), F.lit("svc").alias("service"),
        F.lit("m").alias("model"), F.when(F.col("s_suppkey") % 2 == 0, "0.5").alias("temp"),
    ).write.json(path)
    corpus = _path(s, "sentences")
    by = table(s, d, "region").join(
        table(s, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey"),
    ).groupBy("r_name").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    whole = by.agg(
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("r_name", "names"))))).alias("value")
    )
    whole.coalesce(1).write.text(corpus)
    work = lists.read_sentences(s, corpus).crossJoin(F.broadcast(lists.read_entries(s, path, "all")))
    return work.groupBy("tested_entry", "sentence_category", "category_pos").agg(
        F.count("*").alias("n"), F.max_by("sentence", "sentence_pos").alias("last"),
    )


def report_file(s, d):
    """The leaderboards of all languages written as text, a file each, and read back in the order of the files."""
    path = _path(s, "report")
    sinks.write_lines(reports.leaderboard(_duel_records(s, d), "language"), path, "language")
    rows = s.read.text(path).select("language", "value", F.monotonically_increasing_id().alias("at"))
    place = F.row_number().over(Window.partitionBy("language").orderBy("at"))
    return rows.select("language", place.alias("rank"), F.rtrim("value").alias("line"))


QUERIES = {f.__name__: f for f in (
    latency_file, kv_table, json_cache_file, document_file, list_files, report_file, scoring_prompts,
    connector_requests, connector_replies, entry_lists, judge_registry, sentence_corpus, json_cache_write, duel_fit,
    duel_from_outcomes, duel_leaderboard, leaderboard_report, strengths_ranked, duel_categories,
    category_report, duel_judges, judge_report, comparison_progress, score_counts, mannwhitney_exact, pairwise_plan,
    pairwise_cache, scoring_plan, translation_log, coherence_plan, coherence_nested, coherence_chart, category_chart, overlapped_calls, sampled_order,
    active_learning, latency_stream,
)}


def _prompt(template: str, **values: str) -> str:
    """A template as an SQL expression."""
    out = ["'" + template.replace("'", "''") + "'"]
    for name, value in values.items():
        out = [out[0].replace("{" + name + "}", f"' || {value} || '")]
    return out[0]


def _lang(v):
    return "NULL" if v is None else f"'{v}'"


_LANGUAGES = ", ".join(f"({k}, {', '.join(map(_lang, x))}, '{'Spanish' if x[0] == 'EuropeanSpanish' else x[0]}')" for k, x in enumerate(providers.LANGUAGES))


def oracle(comparisons: str, phi: str) -> dict[str, str]:
    """The SQL; the arguments are the shared definitions of the comparison facts and of the normal distribution."""
    duel = f"""WITH {comparisons},
duel AS (SELECT language, sentence, sentence_category, evaluating_model,
  sentence::BIGINT % 2 AS a_id, 1 - sentence::BIGINT % 2 AS b_id, a_success AS low, b_success AS high, identical,
  CASE WHEN a_success THEN 0 WHEN b_success THEN 1 WHEN identical THEN 2 END AS v FROM comp WHERE a_id < 4
    AND b_id >= 4)"""
    model = """, {name} AS (SELECT *, ln(w / l) AS delta, 1 / w + 1 / l AS var, w + l + t AS m FROM (
  SELECT {by}, (count(*) FILTER (v = 0))::DOUBLE AS w, (count(*) FILTER (v = 1))::DOUBLE AS l,
    (count(*) FILTER (v = 2))::DOUBLE AS t FROM duel GROUP BY {by}))"""
    by_language = duel + model.format(name="fit", by="language") + ", sides AS (SELECT fit.*, i::INT AS i, (1 - 2 * i) * delta / 2 AS theta, sqrt(var) / 2 AS se, CASE WHEN i = 0 THEN w ELSE l END / (w + l) AS s FROM fit CROSS JOIN range(2) r(i))"
    z = "1.959963984540054::DOUBLE"
    ranked = by_language + f""", zs AS (SELECT *, abs(delta) / sqrt(var) AS z FROM sides), {phi},
board AS (SELECT language, i, round(exp(theta - {z} * se), 4) AS low, round(exp(theta), 4) AS mid,
  round(exp(theta + {z} * se), 4) AS high, round(least(1, 2 * tail), 4) AS p,
  row_number() OVER (PARTITION BY language ORDER BY theta DESC, i)::INT AS rank FROM phi)"""
    signal = duel + model.format(name="fit", by="sentence_category") + f""", zs AS (SELECT *,
      abs(delta) / sqrt(var) AS z FROM fit), {phi},
t AS (SELECT sentence_category, sentence, count(*) AS n, count(*) FILTER (v = 0) AS a, count(*) FILTER (v = 1) AS b,
  count(*) FILTER (v = 2) AS t FROM duel GROUP BY ALL),
g AS (SELECT sentence_category, round(avg(greatest(a, b, t) / n), 6) AS agreement,
  round(avg((a + b) / n), 6) AS decisiveness FROM t GROUP BY ALL),
x AS (SELECT g.*, abs(w - l) / (w + l) / 2 AS spread, true AS converged,
  (round(least(1, 2 * tail), 4) < 0.05)::INT::DOUBLE AS significant, true AS model_fitted,
  (round(exp(delta / 2 + {z} * sqrt(var) / 2), 4) - round(exp(delta / 2 - {z} * sqrt(var) / 2), 4) + round(exp(-delta / 2 + {z} * sqrt(var) / 2), 4) - round(exp(-delta / 2 - {z} * sqrt(var) / 2), 4)) / 2 AS width
  FROM g JOIN phi ON g.sentence_category = phi.sentence_category),
y AS (SELECT *,
  round(0.3 * agreement + 0.1 * decisiveness + 2.5 * spread + 0.15 / (width + 1e-6) + 0.2 * significant, 6) AS signal
  FROM x),
sig AS (SELECT *, row_number() OVER (ORDER BY signal DESC, sentence_category)::INT AS rank FROM y)"""
    judged = duel + model.format(name="own", by="evaluating_model") + """,
mj AS (SELECT sentence, arg_min(v, (-c) * 10 + v * CASE WHEN sentence::BIGINT % 2 = 1 AND v < 2 THEN -1
  ELSE 1 END) AS majority FROM (SELECT sentence, v, count(*) AS c FROM duel WHERE v IS NOT NULL GROUP BY ALL)
  GROUP BY sentence),
whole AS (SELECT sum(w) AS w, sum(l) AS l FROM own),
st AS (SELECT evaluating_model AS judge, count(*) AS decisions, count_if(v = majority)::BIGINT AS agreements,
  count_if(v = 2)::BIGINT AS ties,
  count_if(v < 2 AND v = a_id)::BIGINT AS a_wins, count_if(v < 2 AND v <> a_id)::BIGINT AS b_wins FROM duel
    JOIN mj ON duel.sentence = mj.sentence WHERE v IS NOT NULL GROUP BY ALL),
an AS (SELECT j.judge, coalesce(decisions, 0) AS decisions, coalesce(agreements, 0) AS agreements,
  coalesce(ties, 0) AS ties, coalesce(a_wins, 0) AS a_wins, coalesce(b_wins, 0) AS b_wins,
  round(coalesce(agreements / decisions, 0), 6) AS agreement_rate, round(coalesce(ties / decisions, 0), 6) AS tie_rate,
    CASE WHEN own.w > 0 THEN sign((own.w - own.l) * (whole.w - whole.l))::DOUBLE END AS pearson,
  CASE WHEN own.w > 0 THEN sign((own.w - own.l) * (whole.w - whole.l))::DOUBLE END AS spearman, CASE
    WHEN own.w > 0 THEN true END AS converged, coalesce(own.w > 0, false) AS model_fitted
  FROM (VALUES ('jA'), ('jB'), ('jC'), ('jZ')) j(judge) LEFT JOIN st ON st.judge = j.judge LEFT
    JOIN own ON own.evaluating_model = j.judge CROSS JOIN whole),
ja AS (SELECT *, row_number() OVER (ORDER BY agreement_rate DESC, judge)::INT AS rank FROM an)"""
    heads = "substr(sha256({}), 2, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f')"
    flip = heads.format(
        "'COIN FLIP Language:German|Sentence cat:' || p_brand || '|Sentence md5:' || md5(sentence) || '|' || judge || '|' || a_id::VARCHAR || '|' || b_id::VARCHAR"
    )
    shown = _prompt(
        pairwise_plan_of.COMPARE, text="sentence", a="CASE WHEN flip THEN tb ELSE ta END",
        b="CASE WHEN flip THEN ta ELSE tb END",
    )
    pairs = f"""WITH tr AS (SELECT p_brand, p_name || ' ' || p_partkey::VARCHAR AS sentence, k::INT AS id, CASE
      WHEN (p_partkey + k * 3) % 7 = 0 THEN '483' ELSE ' t' || (p_size * (k + 1) % 5)::VARCHAR || CASE
      WHEN k % 2 = 0 THEN chr(10) ELSE '' END END AS t FROM part CROSS JOIN range(4) r(k)),
pr AS (SELECT a.p_brand, a.sentence, a.id AS a_id, b.id AS b_id, a.t AS ta, b.t AS tb, judge FROM tr a
  JOIN tr b ON a.sentence = b.sentence AND a.id < b.id CROSS JOIN (VALUES ('j1'), ('j2')) j(judge)),
fl AS (SELECT *, {flip} AS flip, ta = '483' AS an, tb = '483' AS bn, trim(ta, ' ' || chr(10)) = trim(tb, ' '
  || chr(10)) AS same FROM pr),
an AS (SELECT *, {shown} AS prompt FROM fl), h AS (SELECT *, substr(sha256(prompt), 1, 1) AS h FROM an),
said AS (SELECT *, CASE WHEN h <= '5' THEN 'Translation A' WHEN h <= 'b' THEN 'Translation B'
  WHEN h <= 'd' THEN 'Identical' END AS word FROM h),
o AS (SELECT *, CASE WHEN an AND bn THEN 'none' WHEN an THEN 'b' WHEN bn THEN 'a' WHEN same THEN 'tie'
  WHEN word = 'Identical' THEN 'tie' WHEN word IS NULL THEN NULL WHEN (word = 'Translation A') <> flip THEN 'a'
  ELSE 'b' END AS v FROM said)"""
    trip = "sha256('{} >{}|' || temp || '|' || {{}})".replace(" >", ">")
    there, back = trip.format("English", "German"), trip.format("German", "English")
    usable = "(substr({0}, 1, 1) > '1' AND NOT contains(substr({0}, 1, 12), '483'))"
    rated = _prompt(coherence.RATE, text="sentence", new="text")
    trips = f"""WITH RECURSIVE n AS (SELECT n_regionkey::VARCHAR AS cat, n_name AS sentence,
      row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation),
r AS (SELECT cat, sentence, e.e, e.temp, 0 AS depth, sentence AS text FROM n CROSS JOIN (VALUES ('m0', '0.0'),
  ('m1', '1.0'), ('m2', 'None')) e(e, temp) WHERE k <= 4
  UNION ALL SELECT cat, sentence, e, temp, depth + 1, substr({back.format('there')}, 1, 12) FROM (SELECT *,
    substr({there.format('text')}, 1, 12) AS there, {there.format('text')} AS h FROM r WHERE depth < 3)
  WHERE {usable.format('h')} AND {usable.format(back.format('there'))}),
q AS (SELECT cat AS sentence_cat, sentence, depth::INT AS depth, text AS staged_text, ev AS evaluator, ('0x'
  || substr(sha256({rated}), 1, 2))::INT % 120 AS v, e AS tested_entry FROM r CROSS JOIN (VALUES ('e1'), ('e2')) x(ev)
  WHERE depth > 0),
rated AS (SELECT sentence_cat, sentence, depth, staged_text, evaluator, CASE WHEN v <= 100 THEN v END AS score,
  tested_entry FROM q)"""
    work = """WITH w AS (SELECT language, n_regionkey::VARCHAR AS cat, n_name AS sentence, e.e, sha256('English>'
      || language || '|' || e.temp || '|' || n_name) AS h
  FROM nation CROSS JOIN (VALUES ('German'), ('French')) l(language) CROSS JOIN (VALUES ('m0cs0None', '0.0'),
    ('m1cs0on', '0.0'), ('m2cs1None', '1.0'), ('m3csNoneNone', 'None')) e(e, temp)),
t AS (SELECT *, substr(h, 1, 1) = '1' AS failed, substr(h, 1, 1) = '0' OR contains(substr(h, 1, 12), '483') AS refused,
  substr(h, 1, 12) AS text FROM w)"""
    asked = f"""WITH x AS (SELECT n_name AS key, 'say ' || n_name AS text, 'say \\"' || n_name
      || '\\"\\nnow' AS prompt, 'm' || (n_nationkey % 3)::VARCHAR AS model,
  CASE WHEN n_nationkey % 4 > 0 THEN '"temperature":' || ((n_nationkey % 4) / 2)::DOUBLE::VARCHAR ELSE '' END AS temp,
    n_nationkey % 2 = 0 AS thinking, deepl, ling, hybrid
  FROM nation JOIN (VALUES {_LANGUAGES}) l(k, language, deepl, ling,
    hybrid) ON n_nationkey % {len(providers.LANGUAGES)} = l.k)"""
    chat = """'{"model":"' || model || '"' || CASE WHEN temp = '' THEN '' ELSE ',' || temp END || LIMIT || ',"messages":[{"role":"user","content":"' || PROMPT || '"}]}'"""
    chat_of = lambda limit, prompt="prompt": chat.replace("LIMIT", limit).replace("PROMPT", prompt)
    room = "(length(text) * 6 + 4000)::VARCHAR"
    gemini = """'{"contents":[{"parts":[{"text":"' || PROMPT || '"}]}],"generationConfig":{' || temp || CASE WHEN thinking THEN '' ELSE CASE WHEN temp = '' THEN '' ELSE ',' END || '"thinkingConfig":{"thinkingBudget":0}' END || '}}'"""
    form = lambda **c: " || '&' || ".join(f"'{k}=' || {v}" for k, v in c.items())
    spoken = "replace(text, ' ', '+')"
    sent = {
        ("translate", "openrouter"): (
            "'https://openrouter.ai/api/v1/chat/completions'", chat_of(f"',\"max_tokens\":' || {room}"),
        ),
        ("translate", "anthropic"): ("'https://api.anthropic.com/v1/messages'", chat_of("',\"max_tokens\":1024'")),
        ("translate", "cohere"): ("'https://api.cohere.com/v1/generate'", f"""'{{"model":"' || model || '","prompt":"' || prompt || '","max_tokens":' || {room} || CASE WHEN temp = '' THEN '' ELSE ',' || temp END || '}}'"""),
        ("translate", "deepl"): (
            "'https://api.deepl.com/v2/translate'", form(text=spoken, source_lang="'EN'", target_lang="deepl"),
        ),
        ("translate", "google"): (
            "'https://generativelanguage.googleapis.com/v1beta/models/' || model || ':generateContent'",
            gemini.replace("PROMPT", "prompt"),
        ),
        ("translate", "groq"): ("'https://api.groq.com/openai/v1/chat/completions'", chat_of("''")),
        ("translate", "lingvanex"): (
            "'https://api-b2b.backenster.com/b1/api/v3/translate/'",
            form(**{"from": "'en_US'", "to": "ling", "text": spoken, "platform": "'dp'"}),
        ),
        ("translate", "mistral"): ("'https://api.mistral.ai/v1/chat/completions'", chat_of("''")),
        ("translate", "hybrid"): ("model", """'{"source_lang":"English","target_lang":"' || hybrid || '","text":"' || text || '","formality":"NormalFormality","token":"{key}"}'"""),
        ("judge", "openrouter"): (
            "'https://openrouter.ai/api/v1/chat/completions'",
            chat_of("',\"max_tokens\":9000'", "'Be terse. ' || prompt"),
        ),
        ("judge", "google"): (
            "'https://generativelanguage.googleapis.com/v1beta/models/' || model || ':generateContent'",
            gemini.replace("PROMPT", "'Be terse. ' || prompt"),
        ),
    }
    sql = {
        "connector_requests": asked + " UNION ALL ".join(f" SELECT '{k}' AS kind, '{n}' AS service, key, {url} AS url, {body} AS body FROM x" for (k, n), (url, body) in sent.items()),
        "connector_replies": "WITH n AS (SELECT * FROM nation CROSS JOIN (VALUES " + ", ".join(f"('{n}')" for n in REPLIES) + """) s(service)),
e AS (SELECT service, n_name AS key, CASE WHEN n_nationkey % 4 = 0 THEN service || ': status 500'
  WHEN n_nationkey % 5 = 0 THEN service || ': no text in the reply' WHEN service = 'lingvanex'
  AND n_nationkey % 7 = 0 THEN 'quota' END AS error FROM n)
SELECT service, key, CASE WHEN error IS NULL THEN key END AS value, error FROM e""",
        "entry_lists": """WITH e AS (SELECT 'list' || s_nationkey::VARCHAR AS list_name, s_suppkey::INT AS pos, s_name, CASE s_suppkey % 3 WHEN 1 THEN '0' WHEN 2 THEN '0.33' END AS temp, CASE WHEN s_suppkey % 2 = 0 THEN 'N/A' ELSE 'None' END AS thinking FROM supplier)
SELECT list_name, pos, s_name || 'Coopenrouter' || coalesce(temp, 'None') || thinking AS tested_entry,
  temp::DOUBLE AS temperature,
  '{"model_name":"' || s_name || '","model_company":"Co","inference_service_name":"openrouter"' || CASE WHEN temp IS NULL THEN '' ELSE ',"temp":' || temp::DOUBLE::VARCHAR END || '}' AS model FROM e""",
        "judge_registry": """SELECT 'judge' || (c_custkey % 23)::VARCHAR AS judge, min(c_custkey)::INT AS pos, 'openrouter' AS service, 'm' || min(c_custkey)::VARCHAR AS model, CASE WHEN min(c_custkey) % 2 = 0 THEN 'p' ELSE '' END AS prefix FROM customer GROUP BY c_custkey % 23""",
        "sentence_corpus": """SELECT r_name AS sentence_category, r_regionkey AS category_pos, (row_number() OVER (PARTITION BY r_name
  ORDER BY n_name) - 1)::INT AS sentence_pos, n_name AS sentence FROM region JOIN nation ON n_regionkey = r_regionkey""",
        "json_cache_write": """WITH e AS (SELECT 'm' || (user_id % 90)::VARCHAR AS entry_id, * FROM events), l AS (SELECT entry_id, max(CASE WHEN event_id % 2 = 0 THEN event_id END) AS even, max(event_id) AS any_id FROM e GROUP BY entry_id)
SELECT e.entry_id, 'English' AS source_lang, event_type AS target_lang, props AS text, CASE
  WHEN event_id % 3 > 0 THEN 0.5::DOUBLE END AS temperature, event_id::VARCHAR AS response FROM e
  JOIN l ON e.entry_id = l.entry_id AND event_id = coalesce(even, any_id)""",
        "duel_fit": by_language + f""" SELECT language, i, round(theta, 6) AS theta, round(s, 6) AS strength, round(t / sqrt(w * l), 6) AS tie, round(w * ln(w / m) + l * ln(l / m) + t * ln(t / m), 3) AS log_likelihood,
  round(exp(theta - {z} * se), 4) AS low, round(exp(theta), 4) AS mid,
    round(exp(theta + {z} * se), 4) AS high, 0.95::DOUBLE AS conf_level, true AS converged FROM sides""",
        "duel_from_outcomes": by_language + " SELECT language, i, round(s, 6) AS strength, round(t / sqrt(w * l), 6) AS tie FROM sides",
        "duel_leaderboard": ranked + """ SELECT language, (3 - rank)::INT AS position, '{"model_name":"side ' || i::VARCHAR || '"' || CASE WHEN i = 1 THEN ',"temp":0.5' ELSE '' END || '}' AS model, i AS model_id,
  '{"low":' || low::VARCHAR || ',"mid":' || mid::VARCHAR || ',"high":' || high::VARCHAR || ',"conf_level":0.95}' AS intervals, '{"' || (1 - i)::VARCHAR || '":' || p::VARCHAR || '}' AS p_vals, rank FROM board""",
        "leaderboard_report": ranked + """ SELECT language, rank, rpad(rank::VARCHAR, 5, ' ') || ' ' || rpad('side ' || i::VARCHAR, 35, ' ') || ' ' || rpad(CASE WHEN i = 1 THEN '0.5' ELSE 'None' END, 6, ' ') || ' ' || lpad(printf('%.2f', round(mid, 2)), 10, ' ') || ' '
  || rpad('[' || printf('%.2f', round(low, 2)) || ' - ' || printf('%.2f', round(high, 2)) || ']', 25, ' ') AS line
    FROM board""",
        "strengths_ranked": ranked + " SELECT b.language, rank, b.i, 'side ' || b.i::VARCHAR AS model_name, round(s, 6) AS strength FROM board b JOIN sides ON b.language = sides.language AND b.i = sides.i",
        "duel_categories": signal + " SELECT sentence_category, agreement, decisiveness, round(spread, 6) AS spread, converged, round(width, 6) AS width, round(significant, 6) AS significant, model_fitted, signal, rank FROM sig",
        "category_report": signal + """ SELECT rank, rpad(sentence_category, 20, ' ') || ' | ' || lpad(printf('%.3f', round(signal, 3)), 12, ' ') || ' | ' || lpad(printf('%.3f', round(agreement, 3)), 12, ' ') || ' | ' || lpad(printf('%.3f', round(decisiveness, 3)), 10, ' ') || ' | '
  || lpad(printf('%.4f', round(spread, 4)), 10, ' ') || ' | ' || lpad(printf('%.4f', round(width, 4)), 12, ' ') || ' | '
    || lpad(printf('%.3f', round(significant, 3)), 12, ' ') || ' | ' || rpad('True', 6, ' ') AS line FROM sig""",
        "duel_judges": judged + " SELECT * FROM ja",
        "judge_report": judged + """ SELECT rank, rpad(judge, 40, ' ') || ' | ' || lpad(printf('%.2f', round(100 * agreement_rate, 2)) || '%', 8, ' ') || ' | ' || lpad(decisions::VARCHAR, 9, ' ') || ' | ' || lpad(printf('%.2f', round(100 * tie_rate, 2)) || '%', 6, ' ') || ' | '
  || lpad(coalesce(printf('%.3f', pearson), 'N/A'), 11, ' ') || ' | ' || lpad(coalesce(printf('%.3f',
    spearman), 'N/A'), 10, ' ') || ' | ' || rpad(CASE WHEN model_fitted THEN 'True' ELSE 'False' END, 6, ' ') AS line
    FROM ja""",
        "comparison_progress": f"""WITH {comparisons} SELECT count(*) AS n, count_if(identical)::BIGINT AS ties,
  round(count_if(identical) / count(*), 6) AS tie_rate, round(100 * count(*) / 1000000, 2) AS percent FROM comp""",
        "mannwhitney_exact": """WITH v AS (SELECT r_name AS e, n_nationkey AS x FROM nation JOIN region ON n_regionkey = r_regionkey), u AS (SELECT a.e AS entry_a, b.e AS entry_b, sum(CASE WHEN a.x > b.x THEN 1::DOUBLE WHEN a.x = b.x THEN 0.5 ELSE 0 END) AS u FROM v a CROSS JOIN v b GROUP BY ALL),
m AS (SELECT m, bit_count(m) AS n FROM range(1024) r(m)), w AS (SELECT m, sum(k) - 10 AS u FROM m
  JOIN range(10) s(k) ON (m >> k) & 1 = 1 WHERE n = 5 GROUP BY m),
p AS (SELECT entry_a, entry_b, u.u, 2 * count_if(w.u >= greatest(u.u, 25 - u.u)) / count(*) AS p FROM u CROSS JOIN w
  GROUP BY ALL)
SELECT entry_a, entry_b, u, round(CASE WHEN entry_a = entry_b THEN 1 ELSE least(1, p) END, 6) AS p FROM p""",
        "score_counts": """SELECT r.r_name AS language, 'm' || (l.l_suppkey % 8)::VARCHAR AS tested_entry, o.o_orderpriority AS sentence_category, l.l_returnflag AS evaluating_model, CASE WHEN l.l_discount = 0 THEN -483::DOUBLE ELSE l.l_quantity * 2 END AS score, count(*) AS n
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY ALL""",
        "pairwise_plan": pairs + """ SELECT p_brand AS sentence_category, a_id, b_id, CASE WHEN an OR bn THEN '483-skip' ELSE judge END AS evaluating_model, count(*) AS n, count_if(v = 'a')::BIGINT AS a, count_if(v = 'b')::BIGINT AS b, count_if(v = 'tie')::BIGINT AS t,
  count_if(same AND NOT an AND NOT bn)::BIGINT AS auto FROM o WHERE v IS NOT NULL GROUP BY ALL""",
        "pairwise_cache": pairs + " SELECT word AS verdict, count(DISTINCT prompt || judge) AS n, count(DISTINCT prompt || judge) AS keys FROM o WHERE word IS NOT NULL AND NOT same AND NOT an AND NOT bn GROUP BY word",
        "scoring_plan": work + """, g AS (SELECT language, sentence, text, list(DISTINCT e) AS es FROM t WHERE NOT failed AND NOT refused GROUP BY ALL),
s AS (SELECT language, sentence, string_agg(text, '|' ORDER BY text) AS seed FROM g GROUP BY ALL), j AS (SELECT *
  FROM (VALUES ('j1'), ('j2')) j(judge)),
b AS (SELECT g.*, judge, row_number() OVER (PARTITION BY g.language, g.sentence, judge ORDER BY sha256(seed || '-'
  || judge || chr(1) || text)) - 1 AS id FROM g JOIN s ON g.language = s.language AND g.sentence = s.sentence CROSS
  JOIN j)
SELECT language, sentence, judge, unnest(es) AS tested_entry, text AS translation,
  ((17 * id + 3) % 101)::DOUBLE AS score FROM b UNION ALL SELECT language, sentence, judge, e, NULL, -483 FROM t CROSS
  JOIN j WHERE refused AND NOT failed""",
        "scoring_prompts": work + f""", g AS (SELECT DISTINCT language, sentence, text FROM t WHERE NOT failed AND NOT refused),
s AS (SELECT language, sentence, string_agg(text, '|' ORDER BY text) AS seed FROM g GROUP BY ALL),
b AS (SELECT g.*, judge, row_number() OVER (PARTITION BY g.language, g.sentence, judge ORDER BY sha256(seed || '-'
  || judge || chr(1) || text)) - 1 AS id FROM g JOIN s ON g.language = s.language AND g.sentence = s.sentence CROSS
  JOIN (VALUES ('j1'), ('j2')) j(judge)),
l AS (SELECT language, sentence, judge, string_agg('Translation ID ' || id::VARCHAR || ':' || chr(10) || '```' || text
  || '```' || chr(10), '' ORDER BY id) AS list FROM b GROUP BY ALL),
p AS (SELECT language, sentence,
  judge, {_prompt(scoring.SCORE, target="language", text="sentence", list="list")} AS prompt FROM l)
SELECT language, sentence, judge, length(prompt)::INT AS length, sha256(prompt) AS prompt_sha256, 'COMPARISON hash:'
  || md5(prompt) || ' Model:' || judge AS key FROM p""",
        "latency_file": """SELECT 'm' || (user_id % 8)::VARCHAR AS model_id, event_type AS sentence_cat, count(*) AS n,
  round(sum(value), 4) AS total, round(max(value), 4) AS longest FROM events GROUP BY ALL""",
        "kv_table": """WITH e AS (SELECT 'u' || (user_id % 70)::VARCHAR AS key, event_type AS value, event_id FROM events),
l AS (SELECT key, max(CASE WHEN value = 'click' THEN 1 ELSE 0 END) AS clicked, arg_max(value,
  event_id) FILTER (value <> 'click') AS other FROM e GROUP BY key) SELECT key, CASE WHEN clicked = 1 THEN 'click'
  ELSE other END AS value FROM l WHERE key NOT LIKE '%7'""",
        "document_file": """SELECT r.r_name AS language, 'm' || (l.l_suppkey % 8)::VARCHAR AS name, count(DISTINCT o.o_orderpriority || l.l_returnflag) AS groups, count(*) AS scores, round(sum(CASE WHEN l.l_discount = 0 THEN -483::DOUBLE ELSE l.l_quantity * 2 END), 2) AS total
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY ALL""",
        "list_files": """WITH c AS (SELECT r_name, (dense_rank() OVER (ORDER BY r_name) - 1)::INT AS category_pos, n_name FROM region JOIN nation ON n_regionkey = r_regionkey)
SELECT s_name || 'Cosvc' || CASE WHEN s_suppkey % 2 = 0 THEN '0.5' ELSE 'None' END || 'None' AS tested_entry,
  r_name AS sentence_category, category_pos, count(*) AS n, max(n_name) AS last FROM supplier CROSS JOIN c
  GROUP BY ALL""",
        "report_file": ranked + """ SELECT language, rank, rtrim(rpad(rank::VARCHAR, 5, ' ') || ' ' || rpad('side ' || i::VARCHAR, 35, ' ') || ' ' || rpad(CASE WHEN i = 1 THEN '0.5' ELSE 'None' END, 6, ' ') || ' ' || lpad(printf('%.2f', round(mid, 2)), 10, ' ') || ' '
  || '[' || printf('%.2f', round(low, 2)) || ' - ' || printf('%.2f', round(high, 2)) || ']') AS line FROM board""",
        "translation_log": work + """ SELECT e AS model_id, cat AS sentence_cat, count_if(NOT failed AND NOT refused)::BIGINT AS logged, count_if(NOT failed AND NOT refused)::BIGINT AS timed, count_if(failed)::BIGINT AS failed, coalesce(max(CASE WHEN failed THEN 3 END), 0)::INT AS attempts FROM t GROUP BY ALL
HAVING count_if(failed) > 0 OR count_if(NOT failed AND NOT refused) > 0""",
        "coherence_plan": trips + " SELECT * FROM rated",
        "coherence_nested": trips + """ SELECT sentence_cat, sentence, depth, staged_text, tested_entry, '[' || string_agg('{"evaluator":"' || evaluator || '"' || CASE WHEN score IS NULL THEN '' ELSE ',"score":' || score::VARCHAR END || '}', ',' ORDER BY evaluator) || ']' AS evaluations FROM rated GROUP BY ALL""",
        "overlapped_calls": """SELECT p_partkey::VARCHAR AS key, 'thoughts' || chr(10) || (('0x' || substr(sha256('Rate ' || p_name), 1, 2))::INT % 120)::VARCHAR
  AS value, 1::INT AS attempts FROM part""",
        "category_chart": """WITH a AS (SELECT DISTINCT 'm' || (l_suppkey % 8)::VARCHAR AS e, l_returnflag AS c FROM lineitem
  WHERE l_linenumber = 2)
SELECT x.e AS tested_entry, y.c AS sentence_cat, true AS placed FROM (SELECT DISTINCT e FROM a) x CROSS JOIN (SELECT DISTINCT c FROM a) y""",
        "coherence_chart": """WITH e AS (SELECT DISTINCT 'm' || (l_suppkey % 8)::VARCHAR AS tested_entry, l_linenumber AS depth FROM lineitem) SELECT tested_entry, depth, true AS placed FROM e UNION SELECT tested_entry, 0, true FROM e""",
        "active_learning": f"""WITH {comparisons} SELECT language, (a_id // 2)::INT AS a_id, (b_id // 2)::INT AS b_id, count(*) AS n FROM comp
  WHERE a_id // 2 <> b_id // 2 GROUP BY ALL""",
        "latency_stream": """SELECT date_trunc('hour', ts)::TIMESTAMP AS start, 'm' || (user_id % 8)::VARCHAR AS model_id, count(*) AS n,
  round(sum(value), 4) AS total FROM events GROUP BY ALL""",
    }
    return sql | {"json_cache_file": sql["json_cache_write"]}
