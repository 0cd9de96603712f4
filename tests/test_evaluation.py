"""Edge cases of parsers, models, caches, pairing, providers and the stream."""

import itertools
import json
import math
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import text as tx
from lodestar.functions.stats import normal_cdf, two_sided_p, u_distribution
from lodestar.operators import charts, coherence, davidson, pairing, pairwise, reports, scores
from lodestar.plans import active, coherence as trips_of, pairwise as pairwise_plan, scoring
from lodestar.sources import cache, latency, lists, providers, services, sinks
from lodestar.streaming.latency import read_stream, windowed


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_refusal_rules(spark):
    assert column(spark, ["ab", "483", "x 483 y", "abc", ""], tx.is_refusal) == [True, True, True, False, True]
    assert column(spark, ["ab", "483"], lambda x: tx.is_refusal(x, 0)) == [False, True]


def test_json_scores(spark):
    f = "```"
    cases = [
        (f'ok\n{f}\n[{{"id": 1, "score": 90}}]\n{f}', [(1, 90.0)]),
        (f'{f}[{{"id": 1, "score": 1}}]{f} then {f}[{{"id": 2, "score": 2}}]{f}', [(2, 2.0)]),
        (f'{f}json\n[{{"id": "ID 2", "score": "90"}}]{f}', [(2, 90.0)]),
        ('[{"id": 0, "score": 5.5}, {"id": 0, "score": 6}]', [(0, 5.5), (0, 6.0)]),
        ("prose only", None), (f'{f}{{"id": 1}}{f}', None), (f"{f}17{f}", None), (f'{f}[{{"id": 1, "score": 2}}] and more{f}', None), (None, None),
    ]
    got = column(spark, [c for c, _ in cases], tx.json_scores)
    assert [None if g is None else [(x.id, x.score) for x in g] for g in got] == [w for _, w in cases]


def test_score_tail(spark):
    assert column(spark, ["Score:\n85", "100", "1000", "none", "-5", "999", ""], tx.tail_score) == [85, 100, 0, None, 5, None, None]


def test_verdicts(spark):
    last = ["x\nTranslation A", "Translation B\n ", "Identical", "Translation A or Translation B", "unsure", None]
    assert column(spark, last, lambda x: tx.verdict(x, F.lit(False))) == ["a", "b", "tie", None, None, None]
    assert column(spark, last[:3], lambda x: tx.verdict(x, F.lit(True))) == ["b", "a", "tie"]


def test_keys_and_prompts(spark):
    row = spark.range(1).select(
        tx.entry_id(F.lit("m"), F.lit("c"), F.lit("s"), F.lit(None).cast("double"), F.lit(None).cast("string")).alias("e"),
        tx.fill_prompt("from {a} to {b}.", a=F.lit("x"), b=F.lit("y")).alias("p"), tx.numbered_blocks(F.array(F.lit("t"), F.lit("u"))).alias("n"),
        tx.translation_key(F.lit("English"), F.lit("German"), F.lit("e"), F.lit("hello")).alias("k"),
    ).first()
    assert row.e == "mcsNoneNone" and row.p == "from x to y." and row.n == "Translation ID 0:\n```t```\nTranslation ID 1:\n```u```\n"
    assert row.k == "TRANSLATION From Language:English To Language: German|Model: e|Sentence md5:5d41402abc4b2a76b9719d911017c592"


def test_normal_probabilities_to_the_last_digits(spark):
    zs = [-8.0, -2.0, -0.3, 0.0, 1.96, 4.0, 7.0, 7.5, 12.0, 30.0]
    got = column(spark, zs, normal_cdf, "double")
    assert np.allclose(got, [math.erfc(-z / math.sqrt(2)) / 2 for z in zs], rtol=1e-8, atol=0)
    assert np.allclose(column(spark, zs, two_sided_p, "double"), [math.erfc(abs(z) / math.sqrt(2)) for z in zs], rtol=1e-8, atol=0)


@pytest.mark.parametrize("n,m", [(1, 1), (2, 3), (5, 3), (4, 7)])
def test_exact_distribution_of_u(n, m):
    want = [0] * (n * m + 1)
    for ranks in itertools.combinations(range(n + m), n):
        want[sum(ranks) - n * (n - 1) // 2] += 1
    assert list(u_distribution(n, m)) == want


COMP = "language string, a_id int, b_id int, sentence string, sentence_category string, evaluating_model string, a_success boolean, b_success boolean, identical boolean"


def votes(spark, a, b, t, none=0):
    rows = [("L", 0, 1, "s", "c", f"j{i}", i < a, a <= i < a + b, a + b <= i < a + b + t) for i in range(a + b + t + none)]
    return spark.createDataFrame(rows, COMP)


@pytest.mark.parametrize("counts,want", [((3, 0, 0), ("win_a", 9)), ((2, 1, 0), ("win_a", 3)), ((1, 1, 1), ("tie", 1)), ((0, 0, 3), ("tie", 9)), ((0, 0, 0), None), ((1, 1, 0), None), ((0, 2, 1), ("win_b", 4))])
def test_amplify(spark, counts, want):
    df = votes(spark, *counts, none=1)
    got = [(r.outcome, r.weight) for r in pairwise.amplify(df).collect()]
    assert got == ([want] if want else [])
    assert pairwise.amplified_rows(pairwise.amplify(df)).count() == (want[1] if want else 0)


@pytest.mark.parametrize("counts,want", [((3, 0, 0), 300.0), ((1, 1, 1), -50.0)])
def test_consensus(spark, counts, want):
    assert pairwise.consensus(votes(spark, *counts)).first().consensus == want


def test_majority_ties_go_to_a(spark):
    assert pairwise.majority(votes(spark, 1, 1, 1)).first().majority == "win_a"


def test_facts_of_refusals_equal_texts_and_verdicts(spark):
    rows = [("L", s, "c", 0, 1, a, b, "j", r) for s, a, b, r in [("1", "483", "483", None), ("2", "483", "ok", None), ("3", "ok", "no 483", None), ("4", "x", " x\n", None), ("5", "x", "y", "Translation A"), ("6", "x", "y", "who knows")]]
    df = spark.createDataFrame(rows, "language string, sentence string, sentence_category string, a_id int, b_id int, text_a string, text_b string, judge string, response string")
    got = {r.sentence: (r.evaluating_model, r.a_success, r.b_success, r.identical) for r in pairwise.facts(df).collect()}
    assert got["1"] == ("483-skip", False, False, False) and got["2"] == ("483-skip", False, True, False) and got["3"] == ("483-skip", True, False, False)
    assert got["4"] == ("j", False, False, True) and sorted(got["5"][1:]) == [False, False, True] and "6" not in got


@pytest.mark.parametrize("n", [1, 3, 5])
def test_subsets(spark, n):
    got = pairwise.subsets(spark.createDataFrame([(f"j{i}",) for i in range(n)], "j string"), "j").collect()
    assert len(got) == 2**n - 1 == len({tuple(r.members) for r in got}) and all(r.size == len(r.members) for r in got)


def test_pairing(spark):
    e = spark.createDataFrame([(i, str(i)) for i in range(7)], "pos int, entry string")
    assert sorted((r.entry_a, r.entry_b) for r in pairing.strided(e, 0, 2, 2).collect()) == [("0", "2"), ("2", "4")]
    assert pairing.chain(e).count() == 6
    p = spark.createDataFrame([(0, "x", "y"), (1, "y", "z")], "pos int, entry_a string, entry_b string")
    assert {r.entry: r.id for r in pairing.dense_ids(p).collect()} == {"x": 0, "y": 1, "z": 2}


def test_davidson_two_systems():
    f = davidson.fit_counts([0], [1], [8], [2], [4], 2)
    assert math.isclose(f["theta"][0] - f["theta"][1], math.log(4), abs_tol=1e-9) and math.isclose(f["tie"], 1.0, abs_tol=1e-9) and f["converged"]


def test_davidson_without_data_and_without_maximum():
    f = davidson.fit_counts([], [], [], [], [], 3)
    assert np.allclose(f["strength"], 1 / 3) and math.isclose(f["tie"], 1)
    g = davidson.fit_counts([0], [1], [5], [0], [1], 2)
    assert not g["converged"] and np.isfinite(g["theta"]).all()


def test_davidson_recovers_and_is_symmetric(spark):
    rng = random.Random(1)
    theta, rows = [0.0, 0.5, 1.0, -0.7], []
    for i in range(4):
        for j in range(i + 1, 4):
            w = [math.exp(theta[i]), math.exp(theta[j]), 0.6 * math.exp((theta[i] + theta[j]) / 2)]
            c = rng.choices(range(3), w, k=3000)
            rows.append((i, j, c.count(0), c.count(1), c.count(2)))
    counts = spark.createDataFrame(rows, "i int, j int, w_ij long, w_ji long, t_ij long")
    fitted = davidson.fit(counts, 4)
    got = {r.i: r for r in davidson.intervals(fitted, 0.5).collect()}
    assert all(abs(got[i].theta - (theta[i] - np.mean(theta))) < 0.12 and got[i].converged for i in range(4))
    assert abs(math.prod(got[i].mid for i in range(4)) - 1) < 1e-3
    assert all(abs(math.log(r.mid / r.low) - math.log(r.high / r.mid)) < 0.02 for r in got.values())
    p = {(r.i, r.j): r.p for r in davidson.p_values(fitted).collect()}
    assert len(p) == 12 and all(p[a, b] == p[b, a] and 0 <= p[a, b] <= 1 for a, b in p)
    board = davidson.leaderboard(fitted).orderBy("rank").collect()
    assert [r.i for r in board] == [2, 1, 0, 3] and set(board[0].p_vals) == {"1", "0", "3"}


def test_entropy_of_equals_is_log_three(spark):
    s = spark.createDataFrame([(i, 0.25, 1.0) for i in range(4)], "i int, strength double, tie double")
    got = davidson.probabilities(s).collect()
    assert len(got) == 6 and all(math.isclose(r.entropy, math.log(3), abs_tol=1e-9) for r in got)
    assert (davidson.next_pair(davidson.probabilities(s)).first().i, davidson.next_pair(davidson.probabilities(s)).first().j) == (0, 1)


def test_mann_whitney_by_hand(spark):
    a, b = [1, 2, 2, 5, 9, 9, 10, 11, 12], [0, 2, 3, 3, 4, 5, 6, 7, 8]
    df = spark.createDataFrame([("a", float(x)) for x in a] + [("b", float(x)) for x in b], "tested_entry string, score double")
    got = {(r.entry_a, r.entry_b): r for r in scores.mann_whitney(df).collect()}
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert got["a", "b"].u == u and got["b", "a"].u == 81 - u and got["a", "b"].p == got["b", "a"].p and got["a", "a"].p == 1


def test_median_is_the_upper_one(spark):
    df = spark.createDataFrame([("L", "m", "c", "j", float(x)) for x in (1, 2, 3, 4)], "language string, tested_entry string, sentence_category string, evaluating_model string, score double")
    assert scores.summary(df).first().median == 3


def test_coherence_is_a_mean_of_means(spark):
    df = spark.createDataFrame([("m", "c", "s", 1, "a", 100), ("m", "c", "s", 1, "b", 50), ("m", "c", "t", 1, "a", 0), ("n", "d", "s", 1, "a", 10)], "tested_entry string, sentence_cat string, sentence string, depth int, evaluator string, score int")
    assert {(r.tested_entry, r.depth): r.coherence for r in coherence.by_depth(df).collect()} == {("m", 0): 100, ("n", 0): 100, ("m", 1): 37.5, ("n", 1): 10}
    assert {(r.tested_entry, r.sentence_cat): r.coherence for r in coherence.by_category(df).collect()} == {("m", "c"): 37.5, ("m", "d"): 0, ("n", "c"): 0, ("n", "d"): 10}


def test_kv_table(spark, tmp_path):
    kv = cache.KVTable(spark, f"file://{tmp_path}/kv")
    assert kv.read().count() == 0
    rows = lambda *x: spark.createDataFrame(x, "key string, value string")
    kv.set(rows(("a", "1"), ("b", ""), ("c", None)))
    kv.set(rows(("a", "9"), ("a", "2")))
    kv.delete(rows(("b", None)).select("key"))
    assert [(r.key, r.value) for r in kv.read().collect()] == [("a", "2")]
    assert {(r.key, r.hit) for r in cache.probe(rows(("a", ""), ("z", "")).select("key"), kv.read()).collect()} == {("a", True), ("z", False)}


def test_json_cache(spark, tmp_path):
    assert cache.read_json_cache(spark, f"file://{tmp_path}/none").count() == 0
    c = spark.createDataFrame([("e", "a", "b", "t", None, "r")], cache.JSON_SCHEMA)
    q = spark.createDataFrame([("e", "a", "b", "t", None), ("e", "a", "b", "t", 1.0)], "entry_id string, source_lang string, target_lang string, text string, temperature double")
    assert sorted(str(r.response) for r in cache.probe_json(q, c).collect()) == ["None", "r"]


def flaky():
    class Flaky:
        def infer(self, prompt, temperature):
            if "refuse this" in prompt:
                return "483"
            if "bad" in prompt:
                raise RuntimeError("no")
            return "t:" + prompt[-20:]

        def translate(self, source, target, text, temperature):
            return self.infer(text, temperature)

    return Flaky


def test_provider_retries_and_cache(spark):
    q = spark.createDataFrame([("1", "fine", 0.0), ("1", "fine", 0.0), ("2", "bad", None)], "key string, prompt string, temperature double")
    known = spark.createDataFrame([("9", "x")], "key string, value string")
    done, calls = providers.through_cache(q, known, flaky())
    assert {(r.key, r.value) for r in done.collect()} == {("1", "t:fine"), ("2", None)}
    assert {(r.key, r.attempts, r.error) for r in calls.collect()} == {("1", 1, None), ("2", 3, "RuntimeError: no")}
    assert [r.key for r in scoring.failures(calls).collect()] == ["2"]
    assert providers.languages(spark, True).count() == 14


def test_scoring_plan(spark):
    entries = spark.createDataFrame([("m1", "c", "s", "0", None), ("m2", "c", "s", "1", "on")], "model_name string, model_company string, service string, temp_key string, thinking string")
    sentences = spark.createDataFrame([("short", "hello there"), ("short", "refuse this")], "sentence_category string, sentence string")
    empty = spark.createDataFrame([], "key string, value string")
    work = scoring.workload(providers.languages(spark, True).limit(2), sentences, entries)
    done, calls = scoring.translate(work, empty, flaky())
    assert work.count() == 8 == calls.count() and done.where("refused").count() == 4

    class Judge:
        def infer(self, prompt, temperature):
            return '```[{"id": 0, "score": 70}, {"id": 5, "score": 1}]```'

    judges = spark.createDataFrame([("j1",), ("j2",)], "judge string")
    blind = scoring.blind_lists(done, judges)
    judged, _ = scoring.judge(blind, empty, Judge)
    facts = scoring.score_facts(done, blind, judged, judges)
    # every system refused the second sentence: nothing was judged, and each judge gets its refusals
    assert facts.where("score = 70").count() == 8 and facts.where("score = -483").count() == 8
    assert facts.where("score = -483 and translation is null and sentence = 'refuse this'").count() == 8
    log = scoring.latency_log(done.select("key", F.col("tested_entry").alias("model_id"), F.col("sentence_category").alias("sentence_cat"), "sentence"), calls)
    assert log.count() == 4 and log.where("duration < 0").count() == 0


def test_pairwise_plan_asks_only_what_is_open(spark):
    asked = spark.sparkContext.accumulator(0)

    class Judge:
        def infer(self, prompt, temperature):
            asked.add(1)
            return "I say\nTranslation A"

    texts = [(0, "x"), (1, " x\n"), (2, "y"), (3, "483"), (4, None)]
    rows = spark.createDataFrame([("L", "s", "c", i, t) for i, t in texts], "language string, sentence string, sentence_category string, id int, text string")
    chosen = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (3, 4), (2, 2)], "a_id int, b_id int")
    judges = spark.createDataFrame([("j1",), ("j2",)], "judge string")
    f, calls = pairwise_plan.compare(pairwise_plan.pairs(rows, chosen), judges, spark.createDataFrame([], "key string, value string"), Judge)
    got = sorted((r.a_id, r.b_id, r.evaluating_model, r.a_success or r.b_success, r.identical, r.evaluating_response) for r in f.collect())
    assert asked.value == 2 == calls.count()  # only (0, 2) is open; the system with itself gives no fact
    assert got == [(0, 1, "j1", False, True, "Autoskipped"), (0, 1, "j2", False, True, "Autoskipped"), *[(0, 2, j, True, False, "I say\nTranslation A") for j in ("j1", "j2")],
                   *[(0, 3, "483-skip", True, False, None)] * 2, *[(3, 4, "483-skip", False, False, None)] * 2]
    shown = {r.judge: (r.flipped, r.prompt) for r in pairwise_plan.prompts(pairwise_plan.pairs(rows, chosen).where("a_id = 0 and b_id = 2").crossJoin(judges)).collect()}
    assert all(("A: ```y```" in p) == flipped for flipped, p in shown.values())


def test_coherence_plan_keeps_depths_before_a_refusal(spark):
    class There:
        def translate(self, source, target, text, temperature):
            return "483" if text == "aaa''" else text + "'"

        def infer(self, prompt, temperature):
            return "90" if "```aaa''```" in prompt else "many words, 1000"

    work = trips_of.tasks(spark.createDataFrame([("m", 0.0)], "tested_entry string, temperature double"), spark.createDataFrame([("c", 0, "aaa"), ("c", 1, "bbb"), ("c", 2, "ccc")], "sentence_category string, sentence_pos int, sentence string"), 2)
    none = spark.createDataFrame([], "key string, value string")
    rows, calls = trips_of.batch(work, spark.createDataFrame([("e",)], "judge string"), "German", 2, none, There, There)
    got = sorted((r.sentence, r.depth, r.staged_text, r.score) for r in rows.collect())
    assert got == [("aaa", 1, "aaa''", 90), ("bbb", 1, "bbb''", 0), ("bbb", 2, "bbb" + "'" * 4, 0)]
    assert trips_of.nested(rows).count() == 3 and calls.where("value = '483'").count() == 1


def recorded():
    import json

    def transport(url, headers, body, timeout):
        if "fail" in body:
            raise OSError("down")
        if "busy" in body:
            return 429, "later"
        return 200, json.dumps({"choices": [{"message": {"content": headers["Authorization"] + " " + json.loads(body)["messages"][0]["content"]}}]})

    return transport


def test_services_over_a_recorded_transport(spark):
    rows = spark.createDataFrame([(k, "m", k, k, 0.5, False) for k in ("fine", "fail", "busy")], "key string, model string, prompt string, text string, temperature double, thinking boolean")
    rows = rows.withColumns({"source_code": F.lit("a"), "target_code": F.lit("b")})
    got = {r.key: r for r in services.ask(rows, services.JUDGES["openrouter"], lambda: "sec", "So: ", wait=0, jitter=0, transport=recorded()).collect()}
    assert got["fine"].value == "Bearer sec So: fine" and got["fine"].error is None
    assert got["fail"].value is None and "OSError" in got["fail"].error and got["busy"].error == "openrouter: status 429"
    lacking = rows.withColumn("target_code", F.lit(None).cast("string"))
    got = services.ask(lacking, services.TRANSLATORS["deepl"], lambda: "sec", jitter=0, transport=recorded()).collect()
    assert {(r.value, r.error) for r in got} == {(None, "not supported")}


def test_services_over_http(spark):
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.headers["Content-Type"], json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            body = json.dumps({"translations": [{"combined": False, "text": "no"}, {"combined": True, "text": "yes"}]}).encode()
            self.send_response(200 if len(seen) > 1 else 500)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    rows = spark.createDataFrame([("k", "English", "EuropeanSpanish", "hi", f"http://127.0.0.1:{server.server_port}/x")], "key string, source string, target string, text string, model string")
    rows = rows.withColumns({"prompt": F.lit("-"), "temperature": F.lit(0.0), "thinking": F.lit(False)})
    rows = services.with_codes(rows, providers.languages(spark), services.TRANSLATORS["hybrid"])
    got = services.ask(rows, services.TRANSLATORS["hybrid"], lambda: 't"o', wait=0, jitter=0).collect()
    server.shutdown()
    assert [(r.key, r.value, r.error) for r in got] == [("k", "yes", None)] and len(seen) == 2
    assert seen[1] == ("application/json", {"source_lang": "English", "target_lang": "Spanish", "text": "hi", "formality": "NormalFormality", "token": 't"o'})


def test_lists_from_files(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"short": ["a", "b"], "long": ["c"]}))
    got = [tuple(r) for r in lists.read_sentences(spark, f"file://{tmp_path}/s.json").orderBy("category_pos", "sentence_pos").collect()]
    assert got == [("short", 0, 0, "a"), ("short", 0, 1, "b"), ("long", 1, 0, "c")]
    (tmp_path / "e.json").write_text("\n".join(json.dumps(x) for x in [{"list_name": "x", "pos": 0, "model_name": "m", "model_company": "c", "service": "s", "model": "z", "temp": "0.33"}, {"list_name": "y", "pos": 0}]))
    (r,) = lists.read_entries(spark, f"file://{tmp_path}/e.json", "x").collect()
    assert (r.tested_entry, r.temperature) == ("mcs0.33None", 0.33)
    (tmp_path / "j.json").write_text("\n".join(json.dumps(x) for x in [{"pos": 1, "judge": "j", "model": "late"}, {"pos": 0, "judge": "j", "model": "first"}]))
    (r,) = lists.read_judges(spark, f"file://{tmp_path}/j.json").collect()
    assert (r.judge, r.model, r.prefix) == ("j", "first", "")


def test_sinks_and_charts(spark, tmp_path):
    doc = spark.createDataFrame([("L", [(0, "m")])], "language string, models array<struct<id:int,name:string>>")
    for kind in ("json", "parquet"):
        sinks.write_document(doc, f"file://{tmp_path}/{kind}", kind)
        assert spark.read.format(kind).load(f"file://{tmp_path}/{kind}").select("language").first()[0] == "L"
    lines = spark.createDataFrame([(2, "b"), (1, "a")], "rank int, line string")
    sinks.write_lines(lines, f"file://{tmp_path}/report")
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/report").collect()] == ["a", "b"]
    means = spark.createDataFrame([("m", 0, 100.0), ("m", 1, 50.0)], "tested_entry string, depth int, coherence double")
    sinks.write_text(spark, charts.by_depth(means), f"file://{tmp_path}/c.svg")
    assert 'points="60.00,60.00 730.00,240.00"' in (tmp_path / "c.svg").read_text()
    bars = charts.by_category(spark.createDataFrame([("m", "c", 50.0), ("n", "c", 0.0)], "tested_entry string, sentence_cat string, coherence double"))
    assert bars.count("<rect") == 4 and 'height="180.0"' in bars


def test_json_cache_is_rewritten(spark, tmp_path):
    path = f"file://{tmp_path}/j"
    row = lambda r, seq: spark.createDataFrame([("e", "a", "b", "t", None, r, seq)], cache.JSON_SCHEMA + ", seq long")
    cache.write_json_cache(spark, path, row("1", 0))
    cache.write_json_cache(spark, path, row("2", 1))
    assert [r.response for r in cache.read_json_cache(spark, path).collect()] == ["2"]


def test_reports_without_figures(spark):
    rows = spark.createDataFrame([("j", 0, 0, 0, 0, 0, 0.0, 0.0, None, None, None, False, 1)], "judge string, decisions int, agreements int, ties int, a_wins int, b_wins int, agreement_rate double, tie_rate double, pearson double, spearman double, converged boolean, model_fitted boolean, rank int")
    assert reports.judges(rows).first().line.split(" | ")[1:] == ["   0.00%", "        0", " 0.00%", "        N/A", "       N/A", "False "]


def test_amplified_subsets_by_hand(spark):
    rows = [("L", 0, 1, "s", "c", f"j{k}", x == "a", x == "b", x == "t") for k, x in enumerate("aab")]
    got = {r["mask"]: (r.w_ij, r.w_ji, r.t_ij) for r in pairwise.amplified_subset_counts(spark.createDataFrame(rows, COMP), "evaluating_model").collect()}
    assert got == {1: (1, 0, 0), 2: (1, 0, 0), 3: (4, 0, 0), 4: (0, 1, 0), 7: (3, 0, 0)}


def test_models_start_anywhere_and_tell_when_they_did_not_converge(spark):
    a = davidson.fit_counts([0], [1], [8], [2], [4], 2)
    b = davidson.fit_counts([0], [1], [8], [2], [4], 2, strengths=[0.01, 0.99], tie=5.0)
    assert np.allclose(a["theta"], b["theta"]) and math.isclose(a["tie"], b["tie"])
    lost = spark.createDataFrame([("c", 0, 1, 20, 0, 0)], "sentence_category string, i int, j int, w_ij long, w_ji long, t_ij long")
    assert not any(r.converged for r in davidson.p_values(davidson.fit(lost, 2, "sentence_category"), "sentence_category").collect())


def test_active_learning_ends(spark):
    def compare(pairs):
        return pairs.select("language", F.col("i").alias("a_id"), F.col("j").alias("b_id"), F.lit("s").alias("sentence"), F.lit("c").alias("sentence_category"), F.lit("j").alias("evaluating_model"), F.lit(True).alias("a_success"), F.lit(False).alias("b_success"), F.lit(False).alias("identical"))

    start = votes(spark, 1, 1, 1)
    keep = lambda df: spark.createDataFrame(df.collect(), df.schema)
    rows, rounds = active.learn(start, 3, compare, rounds=4, keep=keep)
    assert 1 <= rounds <= 4 and rows.count() == 3 + rounds
    trips = active.round_trips(spark.createDataFrame([("a",), ("b",)], "sentence string"), 2, lambda d: d, lambda d: d.withColumn("text", F.when(F.col("text") == "a", F.concat("text", F.lit("'")))))
    assert sorted((r.sentence, r.depth, r.text) for r in trips.collect()) == [("a", 1, "a'")]


def test_latency_stream(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    latency.append(spark.createDataFrame([("m", "c", "s", 1.5, 0.0), ("m", "c", "s", 2.5, 60.0), ("m", "c", "s", 1.0, 4000.0)], latency.SCHEMA), path)
    q = windowed(read_stream(spark, path)).writeStream.format("memory").queryName("lat").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.n, r.total) for r in spark.table("lat").collect()) == [(1, 1.0), (2, 4.0)]
    assert latency.summary(latency.read(spark, path)).first().total == 5.0


def test_log_likelihood_is_the_one_that_the_fit_reports(spark):
    counts = spark.createDataFrame([("x", 0, 1, 5, 3, 2), ("x", 0, 2, 1, 4, 0), ("x", 1, 2, 2, 2, 2)], "g string, i int, j int, w_ij long, w_ji long, t_ij long")
    fitted = davidson.fit(counts, 3, "g").collect()
    strengths = spark.createDataFrame([(r.i, r.strength, r.tie) for r in fitted], "i int, strength double, tie double")
    assert davidson.log_likelihood(counts, strengths, "g").first().log_likelihood == pytest.approx(fitted[0].log_likelihood, abs=1e-4)
