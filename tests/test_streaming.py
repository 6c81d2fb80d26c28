import json
import random
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import relational as R
from tidemark.streaming import feeds, guards, signals

T0 = datetime(2026, 1, 5)


def write(spark, tmp, name, rows, schema):
    path = str(tmp / name)
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name).collect()


def at(s):
    return T0 + timedelta(seconds=s)


def test_debounce_rules():
    us = 1_000_000
    assert signals.fire_at_us(0, 100 * us) == 220 * us and signals.fire_at_us(0, 890 * us) == 900 * us
    fired, state = signals.fold_signals(0, None, None, [], [(0, "a"), (60 * us, "b"), (400 * us, "c")])
    assert fired == [(2, 180 * us, ["a", "b"])] and state == (3, 400 * us, 400 * us, ["c"])
    _, state = signals.fold_signals(0, None, None, [], [(i, str(i)) for i in range(12)])
    assert state[0] == 12 and state[3] == [str(i) for i in range(4, 12)]


def test_debounced_stream(spark, tmp_path):
    rows = [[("d", at(0), "a"), ("d", at(30), "b")], [("e", at(4000), "x")], [("e", at(9000), "y")]]
    got = drain(signals.debounced(write(spark, tmp_path, "sig", rows, "domain string, ts timestamp, reason string")), "debounced", "append")
    d = [r for r in got if r["domain"] == "d"]
    assert [(r["generation"], r["fire_at"], r["reasons"]) for r in d] == [(2, at(150), ["a", "b"])]


def test_repeats_are_dropped(spark, tmp_path):
    rows = [[("k1", at(0)), ("k1", at(5)), ("k2", at(1))], [("k1", at(60))]]
    got = drain(signals.without_repeats(write(spark, tmp_path, "jobs", rows, "dedupe_key string, ts timestamp")), "repeats", "append")
    assert sorted(r["dedupe_key"] for r in got) == ["k1", "k2"]


def test_late_builds(spark, rows):
    due = spark.createDataFrame([("a", 3, 5), ("b", 2, 2), ("c", 1, 1)], "domain string, generation int, wanted int")
    built = spark.createDataFrame([("a", 2), ("b", 2)], "domain string, built_generation int")
    assert rows(signals.needs_build(due, built), "domain", "generation", "follow_up") == [("a", 3, True), ("c", 1, False)]


def test_circuit_breaker():
    s = dict(guards.CLOSED)
    for t, job in ((0, "a"), (1, "a"), (2, "a"), (3, "a")):
        s = guards.breaker_step(s, t, job, False)
    assert s["state"] == "closed"  # one job alone opens nothing
    s = guards.breaker_step(s, 4, "b", False)
    assert s["state"] == "open" and not guards.may_pass(s, 303) and guards.may_pass(s, 304)
    probe = guards.breaker_step(s, 400, "p", True)
    assert probe["state"] == "closed" and guards.breaker_step(s, 400, "p", False)["state"] == "open"
    old = guards.breaker_step(dict(guards.CLOSED), 0, "a", False)
    assert len(guards.breaker_step(old, 700, "b", False)["failures"]) == 1 and len(guards.breaker_step(old, 600, "b", False)["failures"]) == 2


def test_a_success_forgets_failures():
    s = dict(guards.CLOSED)
    for t, job, ok in ((0, "a", False), (1, "b", False), (2, "c", False), (3, "d", True), (4, "e", False)):
        s = guards.breaker_step(s, t, job, ok)
    assert s["state"] == "closed" and len(s["failures"]) == 1


def test_pauses_grow_and_a_lost_probe_is_replaced():
    s = {**guards.CLOSED, "state": "open", "opened": 0.0}
    for turn, (at, pause) in enumerate(((300, 900), (1200, 1800), (3000, 1800)), 1):
        s = guards.breaker_step(s, at, "p", False)
        assert s["state"] == "open" and s["turn"] == min(turn, 2) and not guards.may_pass(s, at + pause - 1) and guards.may_pass(s, at + pause)
    ok, s = guards.claim(s, 4800, "lost")
    assert ok and s["state"] == "half_open" and not guards.claim(s, 5699, "next")[0]
    assert guards.failed(s, 5000, "other") == s  # only the probe's outcome counts
    ok, s = guards.claim(s, 5700, "next")
    assert ok and guards.failed(s, 5701, "lost")["state"] == "half_open" and guards.failed(s, 5701, "next")["state"] == "open"


def test_circuit_states_equal_a_walk(spark, rows):
    rng = random.Random(2)
    data = [(rng.choice("xxxxy"), i, i * 37.0 + rng.random(), rng.choice(["a", "b", "c", None]), rng.random() < 0.12) for i in range(900)]
    state, want = {}, []
    for service, n, at_s, job, ok in data:
        state[service] = guards.breaker_step(state.get(service, dict(guards.CLOSED)), at_s, job or "", ok)
        want.append((service, n, state[service]["state"]))
    df = spark.createDataFrame(data, "service string, n long, at double, job string, ok boolean")
    assert rows(guards.circuit_states(df), "service", "n", "state") == sorted(want, key=repr) and len({w[2] for w in want}) >= 2
    assert guards.circuit_states(df.limit(0)).count() == 0


def test_circuit_stream(spark, tmp_path):
    rows = [[("s", at(i), f"j{i}", False) for i in range(4)], [("t", at(9), "j", True)]]
    got = drain(guards.circuit_stream(write(spark, tmp_path, "out", rows, "service string, ts timestamp, job string, ok boolean")), "circuit", "update")
    assert {(r["service"], r["state"]) for r in got} == {("s", "open"), ("t", "closed")}


def test_meter():
    s = dict(guards.EMPTY_METER)
    for day, window, reading in (("1", "w", 10.0), ("1", "w", 12.0), ("1", "w", 11.0), ("1", "w", 15.0), ("1", "v", 2.0), ("1", "v", 3.0)):
        s = guards.meter_step(s, day, window, reading)
    assert s["spent"] == 5.0 + 2.0 + 1.0 and s["uncertain"] == "1"
    s = guards.meter_step(s, "2", "v", 4.0)
    assert s["spent"] == 1.0 and s["uncertain"] == ""
    assert guards.meter_step(s, "3", "u", 9.0)["spent"] == 0.0
    said = [guards.budget_status(*x) for x in ((1, 50, False, 9), (9, 50, False, 9), (1, 50, True, 9), (1, 100, True, 9), (1, None, False, 9), (1, 50, False, 9, True), (99, None, True, 0))]
    assert said == ["ready", "daily_limit", "daily_limit", "weekly_limit", "quota_unavailable", "quota_unavailable", "ready"]


def test_daily_meter_equals_a_walk(spark, rows):
    rng, state, want, data = random.Random(9), {}, {}, []
    for i in range(800):
        account, hour = rng.choice("aab"), i // 3
        day, window, reading = hour // 24, (hour + 12) // 72, float(rng.randrange(0, 90 if account == "a" else 130))
        data.append((account, i, day, window, reading))
        s = state[account] = guards.meter_step(state.get(account, dict(guards.EMPTY_METER)), str(day), str(window), reading)
        want[account, day] = (s["spent"], s["uncertain"] == str(day), guards.budget_status(s["spent"], s["reading"], s["uncertain"] == str(day), 60))
    df = spark.createDataFrame([*data, (None, 1, 1, 1, 1.0), ("a", 5, 1, 1, None)], "account string, n long, day int, window int, reading double")
    got = {(r["account"], r["day"]): (r["spent"], r["uncertain"], r["status"]) for r in guards.daily_meter(df, 60).collect()}
    assert got == want and {w[2] for w in want.values()} == {"ready", "daily_limit", "weekly_limit"}


def test_sessions_equal_folded_signals(spark, rows):
    rng, data, want = random.Random(4), [], []
    for k in "xyz":
        t, times = 0, []
        for _ in range(500):
            t += rng.choice([1, 20, 60, 119, 120, 121, 400, 90_000]) * 1_000_000 if rng.random() < 0.3 else rng.randrange(30) * 1_000_000
            times.append(t)
        data += [(k, x) for x in times]
        fired, (_, first, last, _) = signals.fold_signals(0, None, None, [], [(x, "") for x in times])
        want += [(k, at_us) for _, at_us, _ in fired] + [(k, signals.fire_at_us(first, last))]
    df = spark.createDataFrame([*data, (None, 5), ("x", None)], "k string, t long")
    out = signals.sessions(df, "k", "t")
    assert rows(out, "k", "fire_us") == sorted(want, key=repr) and out.agg(F.sum("signals")).first()[0] == len(data)


def test_weekly_layer_and_usage(spark, tmp_path):
    week, day = 19723, 86_400_000_000
    end = (week + 7) * day
    batches = [[("v", "a", week, end - 1), ("v", "far", 9_999_999, end)], [("v", "b", week + 6, end), ("v", "c", week, end + 14 * day)]]
    log = write(spark, tmp_path, "log", batches, "src string, rec_id string, event_day int, arrived_us long")
    feeds.weekly_fast_layer(log, str(tmp_path / "view"), str(tmp_path / "view-ck")).awaitTermination()
    got = feeds.served_view(spark, str(tmp_path / "view")).where(f"week_day = {week}").collect()
    assert [(r["provisional"], r["corrections"], r["dropped"], r["final"], r["state"]) for r in got] == [(1, 1, 1, 2, "open")]
    calls = write(spark, tmp_path, "calls", [[(at(1), "llm", "chat", 5, True), (at(2), "llm", "chat", 7, False)]], "ts timestamp, service string, operation string, tokens long, ok boolean")
    got = drain(feeds.usage_counters(calls), "usage", "update")
    assert [(r["calls"], r["succeeded"], r["tokens"]) for r in got] == [(2, 1, 12)]


def test_insert_new(spark, tmp_path):
    src, target, ck = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "ck")
    src.mkdir()
    schema = "provider string, provider_video_id string, title string"
    for i, rows in enumerate(([("p", "1", "a"), ("p", "1", "b"), ("p", "2", "c")], [("p", "2", "again"), ("q", "2", "d")])):
        (src / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("provider", "provider_video_id", "title"), r))) for r in rows))
        feeds.insert_new(feeds.landing(spark, str(src), schema), target, ["provider", "provider_video_id"], ck).awaitTermination()
    assert sorted((r[0], r[1]) for r in spark.read.parquet(target).collect()) == [("p", "1"), ("p", "2"), ("q", "2")]


def test_leases_cursors_and_due(spark, rows):
    now = F.lit("2026-01-05 12:00:00").cast("timestamp")
    t = lambda s: datetime(2026, 1, 5, 12) - timedelta(seconds=s)
    jobs = spark.createDataFrame([("old", "w1", t(1000)), ("ok", "w1", t(10)), ("lost", "w2", t(10)), ("never", "w3", t(10))], "id string, worker string, started_at timestamp")
    beats = spark.createDataFrame([("w1", t(5)), ("w2", t(500))], "worker string, updated_at timestamp")
    assert rows(feeds.expired_leases(jobs, beats, now), "id", "reason") == [("lost", "worker"), ("never", "worker"), ("old", "lease")]
    moves = spark.createDataFrame([("d", "p2", t(1)), ("d", "p1", t(9))], "domain string, position string, ts timestamp")
    assert rows(feeds.cursors(moves), "domain", "position") == [("d", "p2")]
    src = spark.createDataFrame([("a", None), ("b", t(7200)), ("c", t(60))], "id string, last_sync timestamp")
    assert rows(feeds.due(src, now, 60, 0), "id") == [("a",), ("b",)]


def test_relational_blocks(spark, rows):
    df = spark.createDataFrame([("k", i, float(i) if i != 3 else None) for i in range(1, 7)], "k string, i int, v double")
    assert [r["m"] for r in R.moving_average(df, ["k"], "i", "v", 2, "m").orderBy("i").collect()] == [1.0, 1.5, None, 4.0, 4.5, 5.5]
    assert rows(R.ranked_lookahead(df, "k", [F.col("i")], "i", 2), "source", "target") == sorted(((a, b) for a in range(1, 7) for b in (a + 1, a + 2) if b <= 6), key=repr)
    months = spark.createDataFrame([(19723, 20088, 3)], "a int, b int, n int")
    assert R.months_covered(months, F.col("a"), F.col("b")).count() == 12
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c")], "id string, parent string")
    assert R.closure(edges, edges.where("id = 'a'"), "id", "parent").count() == 3
    assert R.csv_values(" a, b,a ,", "c", None) == ["a", "b", "c"] and R.clamp_limit("900") == 200 and R.clamp_limit(None) == 50
    assert R.keyset_page(df, "i", 4, 10).count() == 2
