"""Fits of many systems, places in an order, versions, overlapped calls, growing boards."""

import json
import random
import threading
import time
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.functions import stats
from lodestar.functions import text as tx
from lodestar.operators import davidson, many, numbering, pairing, pairwise, scores
from lodestar.plans import scoring
from lodestar.sources import cache, overlap, providers, services, versions
from lodestar.streaming import board

COUNTS = "g string, i int, j int, w_ij long, w_ji long, t_ij long"


def _random_counts(rng, n, groups=("x", "y")):
    rows = []
    for g in groups:
        for i, j in combinations(range(n), 2):
            if rng.random() < 0.7 or j == i + 1:
                rows.append((g, i, j, rng.randrange(1, 9), rng.randrange(1, 9), rng.randrange(0, 5)))
    return rows


def test_many_agree_with_one_task(spark):
    rows = _random_counts(random.Random(1), 7)
    df = spark.createDataFrame(rows, COUNTS)
    one = {(r.g, r.i): r for r in davidson.fit(df, 7, "g").collect()}
    got = many.fit_many(df, "g").collect()
    assert len(got) == 14 and all(r.converged for r in got)
    for r in got:
        assert r.theta == pytest.approx(one[r.g, r.i].theta, abs=1e-6) and r.tie == pytest.approx(one[r.g, r.i].tie, rel=1e-6)
        assert r.strength == pytest.approx(one[r.g, r.i].strength, rel=1e-5) and r.points == pytest.approx(r.expected, rel=1e-7)
    # pairs in either order, in several rows, and rows that say nothing
    split = [(g, j, i, w_ji, w_ij, t) for g, i, j, w_ij, w_ji, t in rows] + [("x", 3, 3, 5, 5, 5), ("x", 1, 2, 0, 0, 0), ("z", 1, 1, 1, 0, 0)]
    again = {(r.g, r.i): r.theta for r in many.fit_many(spark.createDataFrame(split + rows, COUNTS), "g").collect()}
    assert set(again) == set(one) and all(abs(again[k] - one[k].theta) < 1e-6 for k in one)


def test_many_without_groups_ties_data_or_maximum(spark):
    of = lambda *rows: spark.createDataFrame([("", *r) for r in rows], COUNTS).drop("g")
    assert many.fit_many(of()).count() == 0
    got = {r.i: r for r in many.fit_many(of((0, 1, 3, 1, 0))).collect()}  # without ties: odds of 3 to 1
    assert got[0].theta - got[1].theta == pytest.approx(np.log(3), abs=1e-6) and got[0].tie == 0 and got[0].converged
    got = many.fit_many(of((0, 1, 5, 0, 0), (0, 2, 5, 0, 0)), rounds=6).collect()  # never lost: no maximum
    assert not any(r.converged for r in got)
    slow = many.fit_many(of(*[(i, i + 1, 6, 5, 3) for i in range(12)]), rounds=60, tolerance=1e-4).collect()  # a chain: ill-conditioned
    assert all(r.converged for r in slow) and len(slow) == 13


def test_information_times_covariance(spark):
    df = spark.createDataFrame(_random_counts(random.Random(2), 8), COUNTS)
    got = davidson.information_times_covariance(df, davidson.fit(df, 8, "g"), "g").collect()
    assert len(got) == 128 and all(r.product == pytest.approx((r.i == r.k) - 1 / 8, abs=1e-6) for r in got)
    with pytest.raises(ValueError, match="fit_many"):
        davidson.fit(df, davidson.MOST + 1, "g")


def test_fit_of_many_systems_needs_no_dense_design():
    rng = np.random.default_rng(0)
    i, j = rng.integers(0, 400, (2, 6000))
    keep = i < j
    f = davidson.fit_counts(i[keep], j[keep], rng.integers(1, 5, keep.sum()), rng.integers(1, 5, keep.sum()), rng.integers(0, 3, keep.sum()), 400)
    assert f["converged"] and f["cov"].shape == (400, 401)


@pytest.mark.parametrize("n", [0, 1, 500])
def test_places_by_many_tasks(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(10**6), i) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, x int, i int").repartition(5)
    got = {r.i: r.place for r in numbering.numbered(df, ["x", "i"]).collect()}
    assert got == {i: k for k, (_, _, i) in enumerate(sorted(rows, key=lambda r: r[1:]))}
    got = {r.i: r.place for r in numbering.numbered(df, ["x", "i"], by=("g",)).collect()}
    want = {}
    for g in ("a", "b", None):
        want |= {i: k for k, (_, _, i) in enumerate(sorted([r for r in rows if r[0] == g], key=lambda r: r[1:]))}
    assert got == want


def test_order_of_first_appearance(spark):
    rows = [("g", "s2", "c", "j", 1.0, 5), ("g", "s1", "c", "j", 7.0, 2), ("g", "s2", "c", "j", 9.0, 1), ("g", "s1", "c", "j", 3.0, 9)]
    df = spark.createDataFrame(rows, "language string, tested_entry string, sentence_category string, evaluating_model string, score double, seen int")
    got = {r.tested_entry: (r.place, r.scores) for r in scores.group_scores_as_seen(df, "seen").collect()}
    assert got == {"s2": (0, [9.0, 1.0]), "s1": (1, [7.0, 3.0])}
    entries = spark.createDataFrame([("a", i, e) for i, e in enumerate("xyxzxy")] + [("b", 9, "q"), ("b", 7, "p")], "g string, pos int, entry string")
    got = sorted((r.g, r.place, r.entry_a + r.entry_b) for r in pairing.chain_in_order(entries, "g").collect())
    assert got == [("a", 0, "xy"), ("a", 1, "yx"), ("a", 2, "xz"), ("a", 3, "zx"), ("b", 0, "pq")]
    votes = spark.createDataFrame([("s", 0, 1, False, True, False, 0), ("s", 0, 1, True, False, False, 1)], "sentence string, a_id int, b_id int, a_success boolean, b_success boolean, identical boolean, at int")
    assert [pairwise.majority(votes, s).first().majority for s in (None, "at")] == ["win_a", "win_b"]


def _kv(spark, *rows):
    return spark.createDataFrame(list(rows), "key string, value string")


def test_versions_keep_what_two_writers_wrote(spark, tmp_path):
    path = f"file://{tmp_path}/kv"
    work = [(w, k) for w in range(2) for k in range(6)]

    def write(x):
        versions.VersionedTable(spark, path, buckets=4).set(_kv(spark, (f"w{x[0]}k{x[1]}", str(x)), ("both", str(x))))

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(write, work))
    table = versions.VersionedTable(spark, path)
    got = {r.key: r.value for r in table.read().collect()}
    assert table.version() == 12 and set(got) == {"both"} | {f"w{w}k{k}" for w, k in work}
    _, commits = table.manifest()
    last = spark.read.parquet(f"{path}/data/commit={commits[-1].folder}").where("key = 'both'").first().value
    assert got["both"] == last and [c.version for c in commits] == list(range(1, 13))


def test_versions_follow_commits_not_clocks(spark, tmp_path, monkeypatch):
    table = versions.VersionedTable(spark, f"file://{tmp_path}/kv", buckets=4)
    assert table.read().count() == 0 and table.version() == 0 and table.compact() == 0
    table.set(_kv(spark, ("a", "1"), ("b", "2"), ("c", None), (None, "x")))
    monkeypatch.setattr(time, "time", lambda: 0.0)  # a clock that is behind
    table.set(_kv(spark, ("a", "9"), ("a", "3")).coalesce(1))
    table.delete(_kv(spark, ("b", None)))
    assert {(r.key, r.value) for r in table.read().collect()} == {("a", "3")}
    assert {(r.key, r.value) for r in table.read(1).collect()} == {("a", "1"), ("b", "2")}
    got = table.probe(_kv(spark, ("a", ""), ("a", ""), ("b", ""), (None, "")).select("key"))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [("a", "3", True), ("a", "3", True), ("b", None, False), (None, None, False)]))
    with pytest.raises(TypeError, match="strings"):
        table.set(spark.createDataFrame([("a", 1)], "key string, value int"))
    assert table.version() == 3


def test_a_probe_reads_the_asked_buckets_only(spark, tmp_path):
    table = versions.VersionedTable(spark, f"file://{tmp_path}/kv", buckets=16)
    table.set(spark.range(2000).select(F.col("id").cast("string").alias("key"), F.col("id").cast("string").alias("value")))
    one = table.probe(_kv(spark, ("77", "")).select("key"))
    plan = one._jdf.queryExecution().toString()
    assert one.collect()[0].value == "77" and "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "bucket")
    spark.sparkContext.setJobGroup("probe", "probe")
    files = {f.split("bucket=")[1].split("/")[0] for f in table._log(None).where(F.col("bucket").isin([3, 5])).select(F.input_file_name().alias("f")).distinct().toPandas().f}
    assert files == {"3", "5"}


def test_compaction_keeps_what_comes_meanwhile(spark, tmp_path):
    path = f"file://{tmp_path}/kv"
    table, other = versions.VersionedTable(spark, path, 4), versions.VersionedTable(spark, path, 4)
    for k in range(3):
        table.set(_kv(spark, ("a", str(k)), (f"k{k}", "v")))
    table.delete(_kv(spark, ("k0", None)))
    put = table._put

    def slow(rows):  # another writer commits while the compaction writes
        out = put(rows)
        other.set(_kv(spark, ("a", "later"), ("new", "n")))
        return out

    table._put = slow
    assert table.compact() == 6
    want = {("a", "later"), ("k1", "v"), ("k2", "v"), ("new", "n")}
    assert {(r.key, r.value) for r in table.read().collect()} == want and len(table.manifest()[1]) == 2
    assert other.vacuum() == 4 and {(r.key, r.value) for r in other.read().collect()} == want

    def race(rows):  # another compaction comes first
        out = put(rows)
        other.compact()
        return out

    table._put = race
    with pytest.raises(versions.Conflict):
        table.compact()
    assert {(r.key, r.value) for r in table.read().collect()} == want


def test_json_cache_survives_a_writer_that_dies(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    rows = lambda i, r: spark.createDataFrame([(i, "a", "b", "t", 0.5, r, 1)], cache.JSON_SCHEMA + ", seq long")
    cache.write_json_cache(spark, path, rows("x", "1"))
    (tmp_path / "c").rename(tmp_path / "c.old")  # between moving the old one aside and the new one in
    assert cache.read_json_cache(spark, path).first().response == "1"
    cache.write_json_cache(spark, path, rows("y", "2"))
    assert {r.entry_id for r in cache.read_json_cache(spark, path).collect()} == {"x", "y"} and not (tmp_path / "c.old").exists()


@pytest.mark.parametrize("k", [1, 3, 8])
def test_calls_overlap_up_to_a_bound_and_keep_their_order(k):
    now, most, lock, taken = [0], [0], threading.Lock(), [0]

    def ask(i):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(random.Random(i).uniform(0.001, 0.01))
        with lock:
            now[0] -= 1
        return i * i

    def rows():
        for i in range(60):
            taken[0] = i
            yield (i,)

    answers = overlap.overlapped(ask, rows(), k)
    assert next(answers) == 0 and taken[0] <= 2 * k
    assert list(answers) == [i * i for i in range(1, 60)] and most[0] <= k and (k == 1 or most[0] > 1)
    with pytest.raises(ZeroDivisionError):
        list(overlap.overlapped(lambda x: 1 // x, [(1,), (0,), (2,)], k))
    with pytest.raises(ValueError, match="at least one"):
        list(overlap.overlapped(ask, [], 0))


def test_pace_spreads_starts():
    pace, began = overlap.Pace(100), time.monotonic()
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda _: pace.wait(), range(31)))
    assert 0.29 <= time.monotonic() - began < 1.5
    began = time.monotonic()
    [overlap.Pace(None).wait() for _ in range(100)]
    assert time.monotonic() - began < 0.1


def test_a_service_sees_at_most_so_many_calls(spark):
    now, most, lock = [0], [0], threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            with lock:
                now[0] += 1
                most[0] = max(most[0], now[0])
            time.sleep(0.05)
            with lock:
                now[0] -= 1
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"echo": body["n"]}).encode())

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    rows = spark.createDataFrame([(str(i), f"http://127.0.0.1:{server.server_port}/x", "A: {key}", "application/json", json.dumps({"n": i})) for i in range(40)], "key string, url string, header string, kind string, body string").coalesce(1)
    took = {}
    for k in (1, 8):
        most[0], began = 0, time.monotonic()
        got = services.send(rows, lambda: "s", jitter=0, wait=0, at_once=k).collect()
        took[k] = time.monotonic() - began
        assert [json.loads(r.reply)["echo"] for r in got] == list(range(40)) and [r.key for r in got] == [str(i) for i in range(40)]
        assert most[0] <= k and (k == 1 or most[0] > 3)
    server.shutdown()
    assert took[8] < took[1] / 2


def test_providers_overlap(spark):
    class Slow:
        def infer(self, prompt, temperature):
            time.sleep(0.05)
            if prompt == "13":
                raise RuntimeError("unlucky")
            return "a" + prompt

    q = spark.createDataFrame([(str(i), str(i), 0.0) for i in range(40)], "key string, prompt string, temperature double").coalesce(1)
    began = time.monotonic()
    got = providers.call(q, Slow, at_once=10, attempts=2).collect()
    assert time.monotonic() - began < 1.6 and [r.key for r in got] == [str(i) for i in range(40)]
    assert [r.value for r in got] == [None if i == 13 else f"a{i}" for i in range(40)]
    assert (got[13].attempts, got[13].error) == (2, "RuntimeError: unlucky")


def test_quantile_digits(spark):
    ps = [1e-300, 1e-9, 0.0001, 0.02424, 0.02426, 0.25, 0.5, 0.75, 0.975, 0.9999, 0.0, 1.0, -1.0, None]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", stats.normal_quantile(F.col("p")).alias("z")).collect()
    for r in got:
        if r.p is None or not 0 < r.p < 1:
            assert r.z is None
        else:
            assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), rel=1e-12 if 1e-4 <= r.p else 1e-10, abs=1e-15)


def test_levels_can_differ_by_row(spark):
    df = spark.createDataFrame([(0, 0.5, [0.25, 0.0], 0.95), (0, 0.5, [0.25, 0.0], 0.5)], "i int, theta double, cov array<double>, level double")
    got = {r.conf_level: (r.low, r.high) for r in davidson.intervals(df, "level").collect()}
    for level, (low, high) in got.items():
        z = NormalDist().inv_cdf((1 + level) / 2)
        assert (low, high) == (round(np.exp(0.5 - z * 0.5), 4), round(np.exp(0.5 + z * 0.5), 4))


@given(st.lists(st.tuples(st.text(max_size=6), st.integers(0, 30)), min_size=1, max_size=8))
@settings(max_examples=4, deadline=None)
def test_sampled_places_are_those_of_the_standard_library(spark, rows):
    df = spark.createDataFrame([(i, k, n) for i, (k, n) in enumerate(rows)], "i int, k string, n int")
    got = {r.i: r.p for r in df.select("i", tx.sampled_places(F.col("k"), F.col("n")).alias("p")).collect()}
    for i, (k, n) in enumerate(rows):
        assert got[i] == random.Random(k).sample(list(range(n)), n)


def test_sampled_blind_lists(spark):
    texts = ["t%d" % (i % 9) for i in range(14)]
    rows = [("German", "s", "c", t, f"m{i}") for i, t in enumerate(texts)] + [("German", "s", "c", None, "m99")]
    done = spark.createDataFrame(rows, "language string, sentence string, sentence_category string, translation string, tested_entry string")
    judges = spark.createDataFrame([("j1",), ("j2",)], "judge string")
    got = scoring.blind_lists(done, judges, sampled=True)
    assert set(got.columns) == set(scoring.blind_lists(done, judges).columns)
    distinct = sorted(set(texts))
    for j in ("j1", "j2"):
        order = random.Random("|".join(distinct) + "-" + j).sample(distinct, len(distinct))
        found = sorted((r.id, r.translation, tuple(r.entries)) for r in got.where(F.col("judge") == j).collect())
        assert [t for _, t, _ in found] == order and [i for i, _, _ in found] == list(range(9))
        assert all(e == tuple(sorted(f"m{i}" for i, x in enumerate(texts) if x == t)) for _, t, e in found)


def test_odd_replies(spark):
    f = "```"
    cases = [
        (f"{f}[]{f}", []), (f'{f}json[{{"id": " ID 3 ", "score": " 7.5 "}}]{f}', [(3, 7.5)]), (f"{f}null{f}", None),
        (f'{f}[{{"id": 1.5, "score": 2}}]{f}', None), (f'{f}[{{"id": 1}}]{f}', None), (f'{f}[1, 2]{f}', None), ("", None), ("[]", []),
        (f'[{{"id": 1, "score": 2}}], [{{"id": 3, "score": 4}}]', None), (f'{f}[{{"id": 1, "score": "high"}}]{f}', None),
        (f'{f}broken{f}[{{"id": 4, "score": -1e1, "why": {{"a": [1]}}}}]{f}', [(4, -10.0)]),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, x string")
    got = [r.y for r in df.select("i", tx.json_scores(F.col("x")).alias("y")).orderBy("i").collect()]
    assert [None if g is None else [(x.id, x.score) for x in g] for g in got] == [w for _, w in cases]
    assert "Python" not in df.select(tx.json_scores("x"))._jdf.queryExecution().toString()


def _votes(spark, rng, judges, n=120):
    rows = []
    for _ in range(n):
        v = rng.randrange(3)
        a, b = rng.sample(range(4), 2)
        rows.append((str(rng.randrange(9)), a, b, rng.choice(judges), v == 0, v == 1, v == 2))
    return spark.createDataFrame(rows, "sentence string, a_id int, b_id int, evaluating_model string, a_success boolean, b_success boolean, identical boolean")


def test_subset_sums_against_every_subset(spark):
    judges = ["j1", "j2", "j3", "483-skip"]
    df = _votes(spark, random.Random(5), judges)
    got, amplified = Counter(), Counter()
    for mask in range(1, 8):
        of = df.where(F.col("evaluating_model").isin([j for k, j in enumerate(judges[:3]) if mask >> k & 1]))
        size = bin(mask).count("1")
        got.update((mask, size, *r) for r in pairwise.pair_counts(of).collect())
        amplified.update((mask, size, *r) for r in pairwise.amplified_counts(pairwise.amplify(of)).collect())
    cols = ["mask", "size", "i", "j", "w_ij", "w_ji", "t_ij"]
    assert Counter(map(tuple, pairwise.subset_counts(df, "evaluating_model").select(cols).collect())) == got
    assert Counter(map(tuple, pairwise.amplified_subset_counts(df, "evaluating_model").select(cols).collect())) == amplified
    none = df.where("evaluating_model = '483-skip'")
    assert pairwise.subset_counts(none, "evaluating_model").count() == 0 == pairwise.amplified_subset_counts(none, "evaluating_model").count()


def test_subsets_of_too_many_are_refused(spark):
    df = _votes(spark, random.Random(6), [f"j{i:02d}" for i in range(17)], 400)
    for f in (pairwise.subset_counts, pairwise.amplified_subset_counts):
        with pytest.raises(ValueError, match="too many"):
            f(df, "evaluating_model")
    with pytest.raises(Exception, match="over 16 values"):
        pairwise.subsets(df.select("evaluating_model"), "evaluating_model").collect()


def test_a_repeated_batch_counts_once(spark, tmp_path):
    df = _votes(spark, random.Random(7), ["j1", "j2"])
    log = f"file://{tmp_path}/log"
    for k in range(3):
        df.where(F.col("sentence").cast("int") % 3 == k).coalesce(1).write.mode("append").parquet(log)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(log)
    run = lambda where: board.grow(pairwise.watched(stream), f"file://{tmp_path}/out", where, "evaluating_model", fit=lambda c: c.groupBy("evaluating_model").count(), availableNow=True)
    q = run(f"{tmp_path}/cp1")
    q.awaitTermination()
    want = Counter(map(tuple, pairwise.pair_counts(df, "evaluating_model").collect()))
    state = lambda: Counter(tuple(r) for r in board.state(spark, f"file://{tmp_path}/out").select("evaluating_model", "i", "j", "w_ij", "w_ji", "t_ij").collect())
    assert state() == want and board.state(spark, f"file://{tmp_path}/out", "board").count() == 2
    seen = [p["observedMetrics"]["progress"] for p in q.recentProgress if p["observedMetrics"]]
    assert sum(x["n"] for x in seen) == df.count() and sum(x["ties"] for x in seen) == df.where("identical").count()
    steps = board.Steps(spark, f"file://{tmp_path}/out/counts")
    assert len(steps.numbers()) == 2
    run(f"{tmp_path}/cp1").awaitTermination()  # nothing new
    assert state() == want
    run(f"{tmp_path}/cp2").awaitTermination()  # without a checkpoint all batches run again, under the same numbers
    assert state() == want


def test_covariance_of_a_search(spark):
    df = spark.createDataFrame(_random_counts(random.Random(3), 5, ("x",)), COUNTS).drop("g")
    fitted = davidson.fit(df, 5)
    wide = davidson.as_searched(fitted, 5)
    rows = wide.collect()
    assert all(sum(r.cov[:5]) == pytest.approx(1, abs=1e-9) and r.covariance == "searched" for r in rows)
    assert all(sum(r.cov[:5]) == pytest.approx(0, abs=1e-9) for r in fitted.collect())
    p = lambda f: {(r.i, r.j): r.p for r in davidson.p_values(f).collect()}
    assert p(fitted) == p(wide)
