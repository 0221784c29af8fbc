"""Time-ordered operators against plain loops, in batch and as streams."""

from __future__ import annotations

import random
import time
import statistics
from collections import defaultdict, deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wardenlake.functions.windows import last_before, number_rows, running_sum
from wardenlake.operators import rollout as ro
from wardenlake.session import cut_and_count
from wardenlake.streaming import jobs

T0 = datetime(2024, 1, 1)
CHECK_SCHEMA = "check_id string, deployment_id string, ts timestamp_ntz, event_id bigint, success boolean"
REQUEST_SCHEMA = "op string, user_id string, ts timestamp_ntz, event_id bigint"


def checks(seed=1, n=1500):
    rng = random.Random(seed)
    # One check holds most rows; results come in runs; some share an instant.
    rows = []
    for i in range(n):
        check = "hot" if rng.random() < 0.6 else f"c{rng.randint(0, 8)}"
        rows.append((check, f"d{len(check) % 2}", T0 + timedelta(seconds=rng.randint(0, 40) * 600), i, rng.random() < 0.55))
    return rows


def loop_states(rows, healthy_at=2, unhealthy_at=3):
    state = defaultdict(lambda: [0, 0, "UNKNOWN"])
    out = {}
    for check, _, ts, i, success in sorted(rows, key=lambda r: (r[2], r[3])):
        ok, bad, old = state[check]
        ok, bad = (ok + 1, 0) if success else (0, bad + 1)
        new = "HEALTHY" if ok >= healthy_at else "UNHEALTHY" if bad >= unhealthy_at else "DEGRADED"
        state[check] = [ok, bad, new]
        out[i] = (old, new, ok, bad)
    return out


def test_health_states(spark):
    rows = checks()
    got = {r["event_id"]: (r["old_status"], r["status"], r["consecutive_successes"], r["consecutive_failures"])
           for r in ro.health_states(spark.createDataFrame(rows, CHECK_SCHEMA)).collect()}
    assert got == loop_states(rows)


def test_health_fixture(spark):
    rows = [("c", "d", T0 + timedelta(hours=i), i, s) for i, s in enumerate([True, True, False, False, False, True])]
    states = ro.health_states(spark.createDataFrame(rows, CHECK_SCHEMA))
    assert [r["status"] for r in states.orderBy("ts").collect()] == ["DEGRADED", "HEALTHY", "DEGRADED", "DEGRADED", "UNHEALTHY", "DEGRADED"]
    health = ro.deployment_health(ro.latest_check_states(states)).first()
    assert (health["overall_status"], health["health_score"]) == ("DEGRADED", 0.0)


def test_segmented_helpers(spark):
    rng = random.Random(2)
    rows = [("k" if rng.random() < 0.8 else "j", i, rng.choice([None, rng.randint(0, 9)])) for i in rng.sample(range(5000), 600)]
    frame = spark.createDataFrame(rows, "k string, o int, v int")
    segment = F.floor(F.col("o") / 100)
    numbered = {(r["k"], r["o"]): r["ordinal"] for r in number_rows(frame, ["k"], ["o"], segment).collect()}
    before = {(r["k"], r["o"]): r["x"] for r in last_before(frame, ["k"], ["o"], segment, F.col("v"), "x").collect()}
    summed = {(r["k"], r["o"]): r["x"] for r in running_sum(frame, ["k"], ["o"], segment, F.coalesce("v", F.lit(0)), "x").collect()}
    for key in "kj":
        total, last = 0, None
        for n, (_, o, v) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: r[1]), 1):
            total += v or 0
            assert (numbered[key, o], before[key, o], summed[key, o]) == (n, last, total)
            last = v if v is not None else last


def requests(seed=7, n=1500):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", "free"]), "hot" if rng.random() < 0.7 else f"u{rng.randint(0, 3)}",
             T0 + timedelta(seconds=rng.choice([rng.randint(0, 3000), rng.randint(0, 400) * 60])), i) for i in range(n)]
    return rows + [("a", "edge", T0, n), ("a", "edge", T0 + timedelta(seconds=1), n + 1), ("a", "edge", T0 + timedelta(seconds=2), n + 2), ("a", "edge", T0 + timedelta(seconds=60), n + 3)]


LIMIT_ROWS = [("a", 2, 60), ("b", 5, 600)]


def loop_admissions(rows, limits=LIMIT_ROWS):
    rules = {op: (most, span) for op, most, span in limits}
    admitted, out = defaultdict(deque), {}
    for op, user, ts, i in sorted(rows, key=lambda r: (r[2], r[3])):
        if op not in rules:
            out[i] = True
            continue
        most, span = rules[op]
        times = admitted[op, user]
        while times and (ts - times[0]).total_seconds() >= span:
            times.popleft()
        out[i] = len(times) < most
        if out[i]:
            times.append(ts)
    return out


def limits(spark):
    return spark.createDataFrame(LIMIT_ROWS, "op string, max_requests int, window_seconds int")


def test_rate_limit(spark):
    rows = requests()
    got = {r["event_id"]: r["admitted"] for r in ro.rate_limit(spark.createDataFrame(rows, REQUEST_SCHEMA), limits(spark)).collect()}
    expected = loop_admissions(rows)
    assert got == expected
    assert [expected[1500 + i] for i in range(4)] == [True, True, False, True]


def test_limiter_state(spark):
    rows = [("a", "u", T0, 0), ("a", "u", T0 + timedelta(seconds=10), 1), ("a", "u", T0 + timedelta(seconds=20), 2)]
    decisions = ro.rate_limit(spark.createDataFrame(rows, REQUEST_SCHEMA), limits(spark))
    as_of = F.lit((T0 + timedelta(seconds=30)).isoformat(sep=" "))
    state = ro.limiter_state(decisions, limits(spark), as_of).first()
    assert (state["in_window"], state["retry_after"]) == (2, 30)
    assert ro.limiter_statistics(ro.limiter_state(decisions, limits(spark), as_of)).first()["total_requests"] == 2


def metric_rows(values, name="response_time", deployment="d"):
    return [(i, T0 + timedelta(minutes=i), deployment, name, v) for i, v in enumerate(values)]


METRIC_SCHEMA = "event_id bigint, ts timestamp_ntz, deployment_id string, metric_name string, value double"


def test_statistics(spark):
    rng = random.Random(9)
    groups = {"one": [5.0], "two": [1.0, 4.0], "same": [2.0] * 40, "many": [rng.gauss(0, 1) for _ in range(3001)], "even": [float(rng.randint(0, 50)) for _ in range(2000)]}
    rows = [row for name, values in groups.items() for row in metric_rows(values, name)]
    for r in ro.metric_statistics(spark.createDataFrame(rows, METRIC_SCHEMA)).collect():
        values = groups[r["metric_name"]]
        assert r["median"] == statistics.median(values) and r["count"] == len(values)
        assert r["std_dev"] == pytest.approx(statistics.stdev(values) if len(values) > 1 else 0)


def test_threshold_edges(spark):
    rows = (metric_rows([0.05, 0.051, 0.1, 0.11], "error_rate") + metric_rows([2000.0, 2001.0, 5000.0, 5001.0], "response_time")
            + metric_rows([0.95, 0.94, 0.8, 0.79], "health_score"))
    got = [(r["metric_value"], r["severity"]) for r in ro.threshold_alerts(spark.createDataFrame(rows, METRIC_SCHEMA)).collect()]
    assert sorted(got) == sorted([(0.051, "MEDIUM"), (0.1, "MEDIUM"), (0.11, "HIGH"), (2001.0, "MEDIUM"), (5000.0, "MEDIUM"), (5001.0, "HIGH"),
                                  (0.94, "MEDIUM"), (0.8, "MEDIUM"), (0.79, "HIGH")])


def evaluations(seed=5, n=600):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.5 else f"c{rng.randint(0, 20)}", T0 + timedelta(minutes=rng.randint(0, 3000)), i, rng.random() < 0.02, rng.random() < 0.3) for i in range(n)]


EVALUATION_SCHEMA = "canary_id string, ts timestamp_ntz, event_id bigint, should_rollback boolean, should_advance boolean"


def loop_canary(rows):
    percentage, ended, out = defaultdict(int), set(), {}
    for canary, _, i, back, forward in sorted(rows, key=lambda r: (r[1], r[2])):
        if canary in ended:
            continue
        if forward and not back:
            percentage[canary] = next((s for s in ro.CANARY_STEPS if s > percentage[canary]), percentage[canary])
        if back:
            ended.add(canary)
        out[i] = (percentage[canary], "ROLLED_BACK" if back else "COMPLETED" if percentage[canary] >= 100 else "RUNNING")
    return out


def test_canary_progress(spark):
    rows = evaluations()
    got = {r["event_id"]: (r["percentage"], r["state"]) for r in ro.canary_progress(spark.createDataFrame(rows, EVALUATION_SCHEMA)).collect()}
    assert got == loop_canary(rows)


def test_canary_decisions(spark):
    counters = spark.createDataFrame([("a", 0, 10, 0.99), ("b", 2, 10, 0.99), ("c", 0, 10, 0.5), ("d", 0, 0, None)], "canary_id string, errors int, requests int, health_score double")
    got = {r["canary_id"]: (r["should_rollback"], r["should_advance"], r["decision"]) for r in ro.canary_decisions(counters).collect()}
    assert got == {"a": (False, True, "ADVANCE"), "b": (True, True, "ROLLBACK"), "c": (True, True, "ROLLBACK"), "d": (False, True, "ADVANCE")}


# --- streams: shuffled arrival over several files must give the batch answer --------------------
def as_stream(spark, rows, schema, folder, files=3, shuffle=True):
    """Several files, one per micro-batch; rows are shuffled inside the allowed delay."""
    if shuffle:
        random.Random(0).shuffle(rows)
    size = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * size:(i + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def closing(spark, folder, schema, row):
    spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(folder))


FAR = T0 + timedelta(days=400)


def test_health_stream(spark, tmp_path):
    rows = checks(3, 400)
    stream = as_stream(spark, list(rows), CHECK_SCHEMA, tmp_path / "in")
    closing(spark, tmp_path / "in", CHECK_SCHEMA, ("closing", "d", FAR, 10**6, True))
    out = jobs.run_available(jobs.health_stream(stream, "200 days"), str(tmp_path / "out"))
    assert {r["event_id"]: (r["old_status"], r["status"]) for r in out.collect()} == {i: s[:2] for i, s in loop_states(rows).items()}


def test_first_rows_of_streams(spark, tmp_path):
    """The earliest crossing and record come out, whichever file brings them."""
    rng = random.Random(5)
    rows = [(f"d{rng.randint(0, 3)}", "error_rate", T0 + timedelta(minutes=rng.randint(0, 5000)), i, rng.random() / 8) for i in range(300)]
    schema = "deployment_id string, metric_name string, ts timestamp, event_id bigint, value double"
    stream = as_stream(spark, list(rows), schema, tmp_path / "in")
    closing(spark, tmp_path / "in", schema, ("closing", "error_rate", FAR, 10**6, 1.0))
    got = {(r["deployment_id"], r["event_id"], r["value"]) for r in jobs.run_available(jobs.trigger_stream(stream, "200 days"), str(tmp_path / "out")).collect()}
    first = {}
    for d, _, ts, i, v in sorted(rows, key=lambda r: (r[2], r[3])):
        if v > 0.05:
            first.setdefault(d, (d, i, v))
    assert got == set(first.values())


def test_a_key_with_many_waiting_rows(spark, tmp_path):
    """100,000 rows of one check that wait in state over several batches are handled once each, in order."""
    rows = [("hot", "d", T0 + timedelta(seconds=i), i, i % 7 != 0) for i in range(100_000)]
    stream = as_stream(spark, list(rows), CHECK_SCHEMA, tmp_path / "in")
    closing(spark, tmp_path / "in", CHECK_SCHEMA, ("closing", "d", FAR, 10**6, True))
    began = time.perf_counter()
    out = jobs.run_available(jobs.health_stream(stream, "200 days"), str(tmp_path / "out"))
    assert {r["event_id"]: (r["old_status"], r["status"]) for r in out.collect()} == {i: s[:2] for i, s in loop_states(rows).items()}
    assert time.perf_counter() - began < 120


def test_canary_stream(spark, tmp_path):
    rows = evaluations(6, 200)
    stream = as_stream(spark, list(rows), EVALUATION_SCHEMA, tmp_path / "in")
    closing(spark, tmp_path / "in", EVALUATION_SCHEMA, ("closing", FAR, 10**6, False, False))
    out = jobs.run_available(jobs.canary_stream(stream, "200 days"), str(tmp_path / "out"))
    assert {r["event_id"]: (r["percentage"], r["state"]) for r in out.collect()} == loop_canary(rows)


def test_limiter_stream(spark, tmp_path):
    rows = [r for r in requests(8, 300) if r[0] != "free"]
    stream = as_stream(spark, list(rows), REQUEST_SCHEMA, tmp_path / "in")
    closing(spark, tmp_path / "in", REQUEST_SCHEMA, ("a", "closing", FAR, 10**6))
    out = jobs.run_available(jobs.limiter_stream(stream, limits(spark), "200 days"), str(tmp_path / "out"))
    assert {r["event_id"]: r["admitted"] for r in out.collect()} == loop_admissions(rows)


def test_counters_drop_late_rows(spark, tmp_path):
    schema = "ts timestamp_ntz, event_type string"
    on_time = [(T0 + timedelta(minutes=m), "view") for m in range(0, 120, 10)]
    stream = as_stream(spark, on_time, schema, tmp_path / "in", files=1, shuffle=False)
    closing(spark, tmp_path / "in", schema, (T0 + timedelta(hours=6), "view"))
    closing(spark, tmp_path / "in", schema, (T0, "view"))  # five hours late
    closing(spark, tmp_path / "in", schema, (T0 + timedelta(hours=20), "view"))
    out = jobs.run_available(jobs.windowed_counters(stream, "1 hour", "30 minutes"), str(tmp_path / "out"))
    assert sorted(r["n"] for r in out.collect()) == [1, 6, 6]


def test_callbacks(spark, tmp_path):
    seen = []
    stream = as_stream(spark, checks(4, 100), CHECK_SCHEMA, tmp_path / "in", files=1)
    query = jobs.on_change(stream.filter("not success"), lambda frame, batch: seen.append(frame.count()), str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sum(seen) == sum(not r[4] for r in checks(4, 100))


def test_risk_stream_equals_batch(spark, tmp_path):
    schema = "ts timestamp_ntz, path string, content string"
    rows = [(T0 + timedelta(minutes=i), f"f{i}", "mail a@b.co and 10.0.0.1" if i % 2 else "none") for i in range(60)]
    stream = as_stream(spark, rows, schema, tmp_path / "in", files=2, shuffle=False)
    closing(spark, tmp_path / "in", schema, (FAR, "z", ""))
    out = jobs.run_available(jobs.risk_stream(stream, "content", "1 hour", "10 minutes"), str(tmp_path / "out")).collect()
    assert [(r["regulation"], r["findings"], r["risk_score"]) for r in out] == [("GDPR", 60, 90)]


def test_median_of_metrics_with_few_values(spark):
    rng = random.Random(3)
    groups = {"constant": [4.0] * 3000, "two": [1.0] * 1500 + [2.0] * 1500, "two, uneven": [1.0] * 1501 + [2.0] * 1500, "one": [7.5], "pair": [1.0, 4.0],
              "zeros": [-0.0, 0.0, 0.0], "spread": [rng.gauss(0, 1) for _ in range(5001)], "none": [None], "some": [None, 3.0, 1.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, value double")
    got = {r["g"]: r["median"] for r in ro.exact_median(df, ["g"], "value").collect()}
    assert got == {g: statistics.median([v for v in vs if v is not None]) for g, vs in groups.items() if g != "none"}
    plan = ro.exact_median(df, ["g"], "value")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1


def test_blocks_of_a_user_without_a_pause(spark):
    """One user holds nine of ten requests and never pauses; blocks of 200 meet in the same decisions as one task."""
    rng, at, rows = random.Random(3), 0, []
    for i in range(1500):
        at += rng.choice([0, 1, 2, 5, 9])
        rows.append(("a" if i % 4 else "b", "hot" if rng.random() < 0.9 else "cool", T0 + timedelta(seconds=at), i))
    got = ro.rate_limit(spark.createDataFrame(rows, REQUEST_SCHEMA), limits(spark), block=200).collect()
    assert len(got) == len(rows) and {r["event_id"]: r["admitted"] for r in got} == loop_admissions(rows)


def test_small_blocks_settle_in_few_rounds(spark, monkeypatch):
    """A limit that binds in each of 60 blocks: the states run through a span of blocks in one round."""
    rows = [("a", "u", T0 + timedelta(seconds=7 * i), i) for i in range(300)]
    tight, rounds = spark.createDataFrame([("a", 2, 100)], "op string, max_requests int, window_seconds int"), []
    monkeypatch.setattr(ro, "cut_and_count", lambda *given: rounds.append(0) or cut_and_count(*given))
    short = {r["event_id"]: r["admitted"] for r in ro.rate_limit(spark.createDataFrame(rows, REQUEST_SCHEMA), tight, block=5).collect()}
    assert len(rounds) <= 3
    assert short == {r["event_id"]: r["admitted"] for r in ro.rate_limit(spark.createDataFrame(rows, REQUEST_SCHEMA), tight).collect()}
    assert 0 < sum(short.values()) < 100
    monkeypatch.setattr(ro, "SESSION_BLOCK", 40)  # spans of eight blocks have to meet as well
    assert short == {r["event_id"]: r["admitted"] for r in ro.rate_limit(spark.createDataFrame(rows, REQUEST_SCHEMA), tight, block=5).collect()}


def test_keys_that_share_a_bucket_keep_their_own_memory(spark, tmp_path, monkeypatch):
    """Many keys are handled in one call of a processor, each with its own state over several ranges."""
    from wardenlake.streaming import ordered

    monkeypatch.setattr(ordered, "BUCKETS", 2)
    rng = random.Random(8)
    rows = [(f"c{rng.randint(0, 40)}", "d", T0 + timedelta(minutes=37 * i), i, rng.random() < 0.5) for i in range(600)]
    stream = as_stream(spark, list(rows), CHECK_SCHEMA, tmp_path / "in")
    closing(spark, tmp_path / "in", CHECK_SCHEMA, ("closing", "d", FAR, 10**6, True))
    out = jobs.run_available(jobs.health_stream(stream, "200 days", 86_400_000), str(tmp_path / "out"))
    assert {r["event_id"]: (r["old_status"], r["status"]) for r in out.collect()} == {i: s[:2] for i, s in loop_states(rows).items()}
