"""Batch forms of the streaming operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import relational as R
from tidemark.plans.registry import Catalog
from tidemark.sources.tables import table
from tidemark.streaming import feeds, guards, signals

CATALOG = Catalog()
query = CATALOG.query
QUERIES, ORACLES = CATALOG.queries, CATALOG.oracles


@query("SELECT user_id, count(*) AS generation, min(ts) AS first_dirty_at, max(ts) AS last_dirty_at FROM events GROUP BY 1")
def ss01_dirty_generations(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").withColumn("domain", F.col("user_id"))
    return signals.dirty_generations(e).withColumnRenamed("domain", "user_id")


@query("""WITH RECURSIVE e AS (SELECT event_type, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS n FROM events),
f AS (SELECT event_type, n, ts AS last_at, ts AS first_at FROM e WHERE n = 1
  UNION ALL SELECT e.event_type, e.n, e.ts, CASE WHEN e.ts > least(f.last_at + INTERVAL 120 SECONDS, f.first_at + INTERVAL 900 SECONDS) THEN e.ts ELSE f.first_at END FROM f JOIN e ON e.event_type = f.event_type AND e.n = f.n + 1)
SELECT event_type, first_at, max(last_at) AS last_at, count(*) AS signals, least(max(last_at) + INTERVAL 120 SECONDS, first_at + INTERVAL 900 SECONDS) AS fire_at FROM f GROUP BY event_type, first_at""")
def ss02_debounce_sessions(s: SparkSession, d: str) -> DataFrame:
    """Bursts of signals, each fired after a quiet time or the longest wait."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    e = table(s, d, "events").select("event_type", us("ts").alias("at_us"))
    at = lambda c: F.timestamp_micros(F.col(c)).cast("timestamp_ntz")
    out = signals.sessions(e, "event_type", "at_us")
    return out.select("event_type", at("first_us").alias("first_at"), at("last_us").alias("last_at"), "signals", at("fire_us").alias("fire_at"))


@query("SELECT user_id, list_slice(list(event_type ORDER BY ts DESC, event_id DESC), 1, 8) AS reasons FROM events GROUP BY 1")
def ss03_last_reasons(s: SparkSession, d: str) -> DataFrame:
    top = R.first_per_key(table(s, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 8, "k")
    return top.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "event_type"))), lambda x: x["event_type"]).alias("reasons"))


@query("SELECT user_id, event_type, min(ts) AS first_at FROM events GROUP BY ALL")
def ss04_without_repeats(s: SparkSession, d: str) -> DataFrame:
    e = R.first_per_key(table(s, d, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")])
    return e.select("user_id", "event_type", F.col("ts").alias("first_at"))


@query("""WITH b AS (SELECT playlist_id, max(input_generation) FILTER (status = 'ready' AND created_at < TIMESTAMP '2024-09-01') AS built, max(input_generation) AS wanted FROM event_map_snapshot GROUP BY 1)
SELECT s.playlist_id, s.input_generation AS generation, b.wanted > s.input_generation AS follow_up FROM (SELECT DISTINCT playlist_id, input_generation FROM event_map_snapshot) s JOIN b USING (playlist_id) WHERE s.input_generation > coalesce(b.built, 0)""")
def ss05_late_builds(s: SparkSession, d: str, as_of: str = "2024-09-01") -> DataFrame:
    """Generations that were not built yet at a time; all are by the end of the test tables."""
    x = table(s, d, "event_map_snapshot").withColumnRenamed("playlist_id", "domain")
    wanted = x.groupBy("domain").agg(F.max("input_generation").alias("wanted"))
    due = x.select("domain", F.col("input_generation").alias("generation")).distinct().join(wanted, "domain")
    built = x.where((F.col("status") == "ready") & (F.col("created_at") < F.lit(as_of).cast("timestamp_ntz"))).groupBy("domain").agg(F.max("input_generation").alias("built_generation"))
    return signals.needs_build(due, built).withColumnRenamed("domain", "playlist_id")


@query("""WITH n AS (SELECT max(o_orderdate) AS t FROM orders), h AS (SELECT o_custkey AS worker, max(o_orderdate) AS seen FROM orders GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_orderdate < t - INTERVAL 2592000 SECONDS THEN 'lease' ELSE 'worker' END AS reason FROM orders, n JOIN h ON h.worker = o_custkey WHERE o_orderstatus = 'O' AND (o_orderdate < t - INTERVAL 2592000 SECONDS OR h.seen < t - INTERVAL 864000 SECONDS)""")
def ss06_expired_leases(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    jobs = o.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("worker"), F.col("o_orderdate").alias("started_at"))
    heard = o.groupBy(F.col("o_custkey").alias("worker")).agg(F.max("o_orderdate").alias("updated_at"))
    now = o.agg(F.max("o_orderdate")).first()[0]
    out = feeds.expired_leases(jobs, heard, F.lit(now).cast("timestamp_ntz"), 2_592_000, 864_000)
    return out.select(F.col("id").alias("o_orderkey"), "reason")


@query("""WITH RECURSIVE e AS (SELECT user_id % 5 AS service, event_id AS n, epoch_us(ts) / 30000000.0 AS sec, coalesce(json_extract_string(props, '$.k'), '') AS job, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS i
  FROM events WHERE event_type IN ('purchase', 'error', 'view')),
m AS (SELECT service, 0::BIGINT AS i, NULL::BIGINT AS n, 'closed' AS state, CAST([] AS STRUCT(sec DOUBLE, job VARCHAR)[]) AS f, 0 AS turn, 0.0::DOUBLE AS opened, '' AS probe, 0.0::DOUBLE AS probe_at FROM (SELECT DISTINCT service FROM e)
  UNION ALL
  SELECT service, i, n, CASE WHEN ok THEN 'closed' WHEN state = 'closed' THEN CASE WHEN full_up THEN 'open' ELSE 'closed' END WHEN state = 'half_open' AND probe = job THEN 'open' ELSE state END,
    CASE WHEN ok THEN CAST([] AS STRUCT(sec DOUBLE, job VARCHAR)[]) WHEN state = 'closed' THEN seen ELSE f END,
    CASE WHEN ok OR state = 'closed' THEN 0 WHEN state = 'half_open' AND probe = job THEN least(turn + 1, 2) ELSE turn END,
    CASE WHEN (state = 'closed' AND full_up) OR (state = 'half_open' AND probe = job) THEN sec ELSE opened END, probe, probe_at
  FROM (SELECT *, len(seen) >= 4 AND len(list_distinct(list_transform(seen, lambda x: x.job))) >= 2 AS full_up
    FROM (SELECT e.service, e.i, e.n, e.sec, e.job, e.ok, m.f, m.turn, m.opened, list_append(list_filter(m.f, lambda x: x.sec >= e.sec - 600), {'sec': e.sec, 'job': e.job}) AS seen,
        CASE WHEN m.state = 'open' AND e.sec - m.opened >= [300, 900, 1800][m.turn + 1] THEN 'half_open' ELSE m.state END AS state,
        CASE WHEN (m.state = 'open' AND e.sec - m.opened >= [300, 900, 1800][m.turn + 1]) OR (m.state = 'half_open' AND e.sec - m.probe_at >= 900) THEN e.job ELSE m.probe END AS probe,
        CASE WHEN (m.state = 'open' AND e.sec - m.opened >= [300, 900, 1800][m.turn + 1]) OR (m.state = 'half_open' AND e.sec - m.probe_at >= 900) THEN e.sec ELSE m.probe_at END AS probe_at
      FROM m JOIN e ON e.service = m.service AND e.i = m.i + 1)))
SELECT service, n AS event_id, state FROM m WHERE i > 0""")
def ss07_circuit_states(s: SparkSession, d: str) -> DataFrame:
    """Five services whose errors and views are failures of the job that props name and whose purchases are successes; the
    clock runs thirty times slower than that of the events, so that circuits open."""
    e = table(s, d, "events").where("event_type IN ('purchase', 'error', 'view')")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(30_000_000.0)
    out = guards.circuit_states(e.select((F.col("user_id") % 5).alias("service"), F.col("event_id").alias("n"), at.alias("at"), F.get_json_object("props", "$.k").alias("job"), (F.col("event_type") == "purchase").alias("ok")))
    return out.withColumnRenamed("n", "event_id")


@query("""WITH r AS (SELECT user_id, event_id, CAST(ts AS DATE) AS day, floor((epoch(ts) + 43200) / 259200) AS w, value FROM events),
h AS (SELECT *, max(value) OVER (PARTITION BY user_id, w ORDER BY event_id) AS high, max(value) OVER (PARTITION BY user_id, w ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base, lag(day) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM r),
g AS (SELECT *, CASE WHEN base IS NOT NULL THEN high - base WHEN before = day THEN value ELSE 0 END AS added, base IS NULL AND coalesce(before = day, false) AS unsure FROM h),
x AS (SELECT user_id, day, sum(added) AS spent, bool_or(unsure) AS uncertain, arg_max(high, event_id) AS last FROM g GROUP BY ALL)
SELECT user_id, day, round(spent, 4) AS spent, uncertain, CASE WHEN last >= 100 THEN 'weekly_limit' WHEN uncertain OR spent >= 40 THEN 'daily_limit' ELSE 'ready' END AS status FROM x""")
def ss08_daily_meter(s: SparkSession, d: str) -> DataFrame:
    """A meter a user, over windows of three days that change at noon, with a limit of 40 a day."""
    window = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) + 43_200) / 259_200)
    r = table(s, d, "events").select(F.col("user_id").alias("account"), F.col("event_id").alias("n"), F.col("ts").cast("date").alias("day"), window.alias("window"), F.col("value").alias("reading"))
    return guards.daily_meter(r, 40.0).select(F.col("account").alias("user_id"), "day", F.round("spent", 4).alias("spent"), "uncertain", "status")


@query("SELECT id FROM (SELECT m.id, max(v.created_at) AS last_sync FROM media m LEFT JOIN video v ON v.media_id = m.id GROUP BY 1) WHERE last_sync IS NULL OR epoch(TIMESTAMP '2026-06-01') - floor(epoch(last_sync)) >= 43200 * 60")
def ss09_due_sources(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "media").select("id").join(table(s, d, "video").groupBy("media_id").agg(F.max("created_at").alias("last_sync")), F.col("media_id") == F.col("id"), "left")
    return feeds.due(m, F.lit("2026-06-01").cast("timestamp_ntz"), 43_200, 0).select("id")


@query("SELECT CAST(created_at AS DATE) AS day, arg_max(id, (created_at, id)) AS newest FROM asset GROUP BY 1")
def ss10_newest_snapshot(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "asset").groupBy(F.col("created_at").cast("date").alias("day")).agg(F.max_by("id", F.struct("created_at", "id")).alias("newest"))


@query("SELECT date_trunc('hour', ts) AS bucket, event_type, count(*) AS calls, round(sum(value), 4) AS amount FROM events GROUP BY ALL")
def ss11_micro_counters(s: SparkSession, d: str) -> DataFrame:
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("bucket")
    return table(s, d, "events").groupBy(hour, "event_type").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("amount"))


@query("SELECT user_id AS domain, arg_max(event_id, (ts, event_id)) AS position, max(ts) AS moved_at FROM events GROUP BY 1")
def ss12_cursors(s: SparkSession, d: str) -> DataFrame:
    return feeds.cursors(table(s, d, "events").select(F.col("user_id").alias("domain"), F.col("event_id").alias("position"), "ts"))


@query("""SELECT period_start, CASE WHEN period_start = DATE '2026-03-11' THEN greatest(TIMESTAMP '2026-03-11 06:00:00', last_ready_at + INTERVAL 60 MINUTES) ELSE TIMESTAMP '2026-03-11 19:30:00' END AS scheduled_for
FROM (SELECT CAST(created_at AS DATE) AS period_start, max(created_at) AS last_ready_at FROM brief_reference GROUP BY 1)""")
def ss13_refresh_schedule(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "brief_reference").groupBy(F.col("created_at").cast("date").alias("period_start")).agg(F.max("created_at").alias("last_ready_at"))
    out = feeds.refresh_schedule(p, F.lit("2026-03-11 06:00:00").cast("timestamp_ntz"), 60, 3, 30, "Asia/Shanghai")
    return out.select("period_start", F.col("scheduled_for").cast("timestamp_ntz").alias("scheduled_for"))


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200")
def ss14_pushed_list(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(200).select("o_orderkey", "o_orderstatus")
