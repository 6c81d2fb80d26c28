"""Counts, time buckets, coverage and usage over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import times as D
from tidemark.operators import relational as R
from tidemark.plans.registry import Catalog
from tidemark.sources.tables import table

CATALOG = Catalog()
query = CATALOG.query
QUERIES, ORACLES = CATALOG.queries, CATALOG.oracles

STATUSES = ["F", "O", "P"]


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def ag01_count_by_key(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p,
count(*) AS total, round(100.0 * count(*) / (SELECT count(*) FROM orders), 2) AS percent FROM orders GROUP BY 1""")
def ag02_nested_counts(s: SparkSession, d: str) -> DataFrame:
    return R.counts_by(table(s, d, "orders"), "o_orderpriority", "o_orderstatus", STATUSES)


@query("SELECT playlist_id, count(*) AS total, count(*) FILTER (start_day IS NOT NULL) AS timed, count(*) FILTER (vector IS NOT NULL) AS embedded FROM event_record GROUP BY 1")
def ag03_conditional_counts(s: SparkSession, d: str) -> DataFrame:
    n = lambda c: F.count_if(F.col(c).isNotNull())
    return table(s, d, "event_record").groupBy("playlist_id").agg(F.count("*").alias("total"), n("start_day").alias("timed"), n("vector").alias("embedded"))


@query("""WITH a AS (SELECT playlist_id, count(*) AS total, count(*) FILTER (len(vector) = 64) AS ready, count(*) FILTER (len(vector) = 64 AND start_day IS NOT NULL) AS eligible, count(*) FILTER (vector IS NOT NULL AND len(vector) <> 64) AS failed FROM event_record GROUP BY 1)
SELECT playlist_id, greatest(0, ready - eligible) AS missing_event_time, greatest(0, failed) AS embedding_failed, greatest(0, total - ready - failed) AS embedding_not_ready FROM a""")
def ag04_exclusive_buckets(s: SparkSession, d: str) -> DataFrame:
    ok = F.col("vector").isNotNull() & (F.size("vector") == 64)
    a = table(s, d, "event_record").groupBy("playlist_id").agg(F.count("*").alias("total"), F.count_if(ok).alias("ready"), F.count_if(ok & F.col("start_day").isNotNull()).alias("eligible"), F.count_if(F.col("vector").isNotNull() & ~ok).alias("failed"))
    c = F.col
    return a.select("playlist_id", R.clamped_rest(c("ready"), c("eligible")).alias("missing_event_time"), R.clamped_rest(c("failed"), F.lit(0)).alias("embedding_failed"), R.clamped_rest(c("total"), c("ready"), c("failed")).alias("embedding_not_ready"))


@query("SELECT playlist_id, count(DISTINCT event_id) AS events, count(DISTINCT source_video_id) AS videos FROM event_record GROUP BY 1")
def ag05_count_distinct(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "event_record").groupBy("playlist_id").agg(F.countDistinct("event_id").alias("events"), F.countDistinct("source_video_id").alias("videos"))


@query("SELECT count(*) AS entity_count FROM (SELECT DISTINCT e.entity_type, e.key FROM (SELECT unnest(entities) AS e FROM event_record))")
def ag06_distinct_pairs(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "event_record").select(F.explode("entities").alias("e")).select("e.entity_type", "e.key")
    return e.distinct().agg(F.count("*").alias("entity_count"))


@query("""WITH p AS (SELECT video_id, max(CASE WHEN status = 'accepted' THEN 1 ELSE 0 END) AS good, max(CASE WHEN status = 'rejected' THEN 1 ELSE 0 END) AS bad FROM video_time_evidence GROUP BY 1)
SELECT count(*) AS videos, CAST(sum(good) AS BIGINT) AS accepted, CAST(sum(bad) AS BIGINT) AS rejected, CAST(sum(CASE WHEN good = 0 AND bad = 0 THEN 1 ELSE 0 END) AS BIGINT) AS waiting FROM p""")
def ag07_two_phase_flags(s: SparkSession, d: str) -> DataFrame:
    flag = lambda v: F.max(F.when(F.col("status") == v, 1).otherwise(0))
    p = table(s, d, "video_time_evidence").groupBy("video_id").agg(flag("accepted").alias("good"), flag("rejected").alias("bad"))
    return p.agg(F.count("*").alias("videos"), F.sum("good").alias("accepted"), F.sum("bad").alias("rejected"), F.sum(F.when((F.col("good") == 0) & (F.col("bad") == 0), 1).otherwise(0)).alias("waiting"))


@query("""WITH v AS (SELECT DISTINCT id, media_id, published_at IS NOT NULL AS timed FROM video WHERE status <> 'deleted'),
f AS (SELECT v.id, v.media_id, v.timed, v.id IN (SELECT video_id FROM asset WHERE type = 'transcript' AND video_id IS NOT NULL) AS transcribed, v.id IN (SELECT source_video_id FROM event_record WHERE source_video_id IS NOT NULL) AS extracted FROM v)
SELECT m.provider, count(*) AS videos, round(avg(CAST(timed AS INTEGER)), 6) AS timed_ratio, round(avg(CAST(transcribed AS INTEGER)), 6) AS transcript_ratio, round(avg(CAST(extracted AS INTEGER)), 6) AS extracted_ratio,
round(CASE WHEN count(*) FILTER (transcribed) > 0 THEN count(*) FILTER (transcribed AND extracted) / count(*) FILTER (transcribed) ELSE 0.0 END, 6) AS yield_ratio FROM f JOIN media m ON m.id = f.media_id GROUP BY 1""")
def ag08_four_ratio_coverage(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "video").where("status <> 'deleted'").select("id", "media_id", F.col("published_at").isNotNull().alias("timed")).distinct()
    mark = lambda df, c, flag: df.select(F.col(c).alias("id"), F.lit(True).alias(flag)).distinct()
    f = v.join(mark(table(s, d, "asset").where("type = 'transcript'"), "video_id", "transcribed"), "id", "left").join(mark(table(s, d, "event_record"), "source_video_id", "extracted"), "id", "left").fillna(False)
    m = table(s, d, "media").select(F.col("id").alias("media_id"), "provider")
    n = lambda c: F.count_if(F.expr(c))
    out = f.join(m, "media_id").groupBy("provider").agg(F.count("*").alias("videos"), n("timed").alias("t"), n("transcribed").alias("x"), n("extracted").alias("e"), n("transcribed AND extracted").alias("b"))
    r = lambda a, b, c: F.round(R.ratio(F.col(a), F.col(b)), 6).alias(c)
    return out.select("provider", "videos", r("t", "videos", "timed_ratio"), r("x", "videos", "transcript_ratio"), r("e", "videos", "extracted_ratio"), r("b", "x", "yield_ratio"))


@query("SELECT m.provider, count(*) AS n, min(v.published_at) AS first_at, max(v.published_at) AS last_at FROM video v JOIN media m ON m.id = v.media_id GROUP BY 1")
def ag09_time_stats(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "media").select(F.col("id").alias("media_id"), "provider")
    return table(s, d, "video").join(m, "media_id").groupBy("provider").agg(F.count("*").alias("n"), F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"))


@query("SELECT playlist_id, round(CASE WHEN count(DISTINCT event_id) > 0 THEN count(DISTINCT event_id) FILTER (len(vector) = 64) / count(DISTINCT event_id) ELSE 0.0 END, 6) AS coverage FROM event_record GROUP BY 1")
def ag10_coverage_ratio(s: SparkSession, d: str) -> DataFrame:
    ok = F.when(F.size("vector") == 64, F.col("event_id"))
    r = table(s, d, "event_record").groupBy("playlist_id").agg(F.countDistinct(ok).alias("a"), F.countDistinct("event_id").alias("b"))
    return r.select("playlist_id", F.round(R.ratio(F.col("a"), F.col("b")), 6).alias("coverage"))


_ENTITY = "SELECT DISTINCT event_id, playlist_id, start_day, end_day, e.entity_type, e.key, e.name FROM (SELECT event_id, playlist_id, start_day, end_day, unnest(entities) AS e FROM event_record)"


def _entities(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "event_record").select("event_id", "playlist_id", "start_day", "end_day", F.explode("entities").alias("e"))
    return r.select("event_id", "playlist_id", "start_day", "end_day", "e.entity_type", "e.key", "e.name").distinct()


@query(f"SELECT entity_type, name, key, count(DISTINCT event_id) AS n FROM ({_ENTITY}) WHERE name ILIKE '%an%' GROUP BY ALL ORDER BY n DESC, entity_type, key, name LIMIT 40")
def ag11_entity_suggestions(s: SparkSession, d: str) -> DataFrame:
    e = _entities(s, d).where(F.col("name").ilike("%an%"))
    return e.groupBy("entity_type", "name", "key").agg(F.countDistinct("event_id").alias("n")).orderBy(F.desc("n"), "entity_type", "key", "name").limit(40)


@query(f"SELECT entity_type, key, min(name) AS name, count(DISTINCT event_id) AS n FROM ({_ENTITY}) WHERE end_day >= 20100 AND start_day <= 20400 GROUP BY ALL ORDER BY n DESC, entity_type, key LIMIT 40")
def ag12_entity_ranking_window(s: SparkSession, d: str) -> DataFrame:
    e = _entities(s, d).where(R.overlaps(F.col("start_day"), F.col("end_day"), 20100, 20400))
    return e.groupBy("entity_type", "key").agg(F.min("name").alias("name"), F.countDistinct("event_id").alias("n")).orderBy(F.desc("n"), "entity_type", "key").limit(40)


@query("SELECT date_trunc('hour', ts) AS bucket, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1")
def ag13_time_bucket_series(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("bucket"))
    return e.agg(*[F.count_if(F.col("event_type") == t).alias(t) for t in ("click", "error", "purchase")])


def _period_sql(unit: str) -> str:
    return f"SELECT CAST(date_trunc('{unit}', ts + INTERVAL 8 HOURS) AS DATE) AS period_start, count(*) AS n FROM events GROUP BY 1"


def _periods(s: SparkSession, d: str, unit: str) -> DataFrame:
    day = D.local_date(F.col("ts"), "Asia/Shanghai")
    return table(s, d, "events").groupBy(D.period_start(day, unit).alias("period_start")).agg(F.count("*").alias("n"))


@query(_period_sql("day"))
def ag14_period_counts_day(s: SparkSession, d: str) -> DataFrame:
    return _periods(s, d, "day")


@query(_period_sql("week"))
def ag14_period_counts_week(s: SparkSession, d: str) -> DataFrame:
    return _periods(s, d, "week")


@query(_period_sql("month"))
def ag15_period_counts_month(s: SparkSession, d: str) -> DataFrame:
    return _periods(s, d, "month")


@query("""WITH c AS (SELECT DISTINCT snapshot_id, canonical_id, event_start_day AS a, greatest(event_start_day, event_end_day) AS b, member_count AS m FROM event_map_canonical WHERE event_start_day IS NOT NULL AND event_end_day IS NOT NULL),
x AS (SELECT snapshot_id, m, unnest(generate_series(date_trunc('month', DATE '1970-01-01' + a), date_trunc('month', DATE '1970-01-01' + b), INTERVAL 1 MONTH)) AS month FROM c)
SELECT snapshot_id, strftime(month, '%Y-%m') AS month, count(*) AS canonical_count, CAST(sum(m) AS BIGINT) AS record_count FROM x GROUP BY ALL""")
def ag16_monthly_distribution(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "event_map_canonical").where("event_start_day IS NOT NULL AND event_end_day IS NOT NULL").select("snapshot_id", "canonical_id", "event_start_day", "event_end_day", "member_count").distinct()
    x = R.months_covered(c, F.col("event_start_day"), F.col("event_end_day"))
    return x.groupBy("snapshot_id", F.date_format("month", "yyyy-MM").alias("month")).agg(F.count("*").alias("canonical_count"), F.sum("member_count").alias("record_count"))


@query("SELECT type, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes, count(*) FILTER (size_bytes IS NULL) AS missing_size FROM (SELECT DISTINCT * FROM asset) GROUP BY 1 ORDER BY bytes DESC")
def ag17_inventory(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "asset").distinct().groupBy("type").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"), F.count_if(F.col("size_bytes").isNull()).alias("missing_size"))
    return a.orderBy(F.desc("bytes"), "type")


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS calls, round(sum(value), 4) AS total, max(ts) AS last_called FROM events GROUP BY ALL")
def ag18_daily_usage(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").groupBy(F.col("ts").cast("date").alias("day"), "event_type").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("total"), F.max("ts").alias("last_called"))


@query("SELECT day, event_id, value FROM (SELECT CAST(ts AS DATE) AS day, event_id, value, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def ag19_newest_per_day(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("x"))
    return e.select("day", "x.event_id", "x.value")


@query("""WITH a AS (SELECT DISTINCT id, CAST(created_at AS DATE) AS day, size_bytes FROM asset), d AS (SELECT day, sum(coalesce(size_bytes, 0)) AS b FROM a GROUP BY 1),
sp AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY)) AS DATE) AS day)
SELECT sp.day, CAST(sum(coalesce(d.b, 0)) OVER (ORDER BY sp.day) AS BIGINT) AS total_bytes FROM sp LEFT JOIN d USING (day)""")
def ag20_cumulative_size(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "asset").select("id", F.col("created_at").cast("date").alias("day"), "size_bytes").distinct()
    per = a.groupBy("day").agg(F.sum(F.coalesce("size_bytes", F.lit(0))).alias("b"))
    spine = per.agg(F.min("day").alias("a"), F.max("day").alias("z")).select(F.explode(D.spine(F.col("a"), F.col("z"), "day")).alias("day"))
    # One row a day: the running total is over a calendar, not over the log.
    return R.running_total(R.gap_filled(per, "day", spine, ["b"]), "day", "b", "total_bytes").select("day", "total_bytes")


@query("SELECT CAST(created_at + INTERVAL 8 HOURS AS DATE) AS day, count(DISTINCT video_id) AS downloads FROM asset WHERE type = 'video' AND coalesce(variant, '') <> 'raw' GROUP BY 1")
def ag21_daily_completed(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "asset").where("type = 'video' AND coalesce(variant, '') <> 'raw'")
    return a.groupBy(D.local_date(F.col("created_at"), "Asia/Shanghai").alias("day")).agg(F.countDistinct("video_id").alias("downloads"))


@query("""WITH u AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL), f AS (SELECT event_type, min(day) AS first_day FROM u GROUP BY 1),
sp AS (SELECT CAST(unnest(generate_series((SELECT max(day) FROM u) - 6, (SELECT max(day) FROM u), INTERVAL 1 DAY)) AS DATE) AS day)
SELECT f.event_type, sp.day, CASE WHEN sp.day >= f.first_day THEN coalesce(u.n, 0) END AS calls FROM f CROSS JOIN sp LEFT JOIN u ON u.event_type = f.event_type AND u.day = sp.day""")
def ag22_usage_window(s: SparkSession, d: str, days: int = 7) -> DataFrame:
    u = table(s, d, "events").groupBy(F.col("ts").cast("date").alias("day"), "event_type").agg(F.count("*").alias("n"))
    last = u.agg(F.max("day")).scalar()
    f = u.groupBy("event_type").agg(F.min("day").alias("first_day"))
    grid = f.select("event_type", "first_day", F.explode(D.spine(F.date_add(last, 1 - days), last, "day")).alias("day"))
    calls = F.when(F.col("day") >= F.col("first_day"), F.coalesce("n", F.lit(0)))
    return grid.join(u, ["event_type", "day"], "left").select("event_type", "day", calls.alias("calls"))


@query("""WITH e AS (SELECT user_id, event_id, ts, event_type, CAST(props->>'$.k' AS BIGINT) AS k FROM events), st AS (SELECT user_id, k, min(ts) AS t FROM e WHERE event_type = 'view' GROUP BY ALL)
SELECT CAST(e.ts AS DATE) AS day, count(*) AS calls, CAST(sum(CASE WHEN st.t IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unpaired FROM e LEFT JOIN st ON st.user_id = e.user_id AND st.k = e.k AND st.t <= e.ts WHERE e.event_type = 'click' GROUP BY 1""")
def ag23_paired_events(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("long"))
    st = e.where("event_type = 'view'").groupBy("user_id", "k").agg(F.min("ts").alias("t"))
    j = e.where("event_type = 'click'").join(st, ["user_id", "k"], "left")
    unpaired = F.col("t").isNull() | (F.col("t") > F.col("ts"))
    return j.groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("calls"), F.sum(F.when(unpaired, 1).otherwise(0)).alias("unpaired"))


@query("SELECT event_type, CAST(sum(coalesce(CAST(props->>'$.total' AS BIGINT), CAST(props->>'$.k' AS BIGINT), 0)) AS BIGINT) AS tokens FROM events GROUP BY 1")
def ag24_usage_from_json(s: SparkSession, d: str) -> DataFrame:
    k = lambda p: F.get_json_object("props", p).try_cast("long")
    return table(s, d, "events").groupBy("event_type").agg(F.sum(F.coalesce(k("$.total"), k("$.k"), F.lit(0))).alias("tokens"))


@query("SELECT playlist_id, max(created_at) AS latest FROM event_record GROUP BY 1 ORDER BY latest DESC, playlist_id LIMIT 4")
def ag25_latest_per_domain(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "event_record").groupBy("playlist_id").agg(F.max("created_at").alias("latest")).orderBy(F.desc("latest"), "playlist_id").limit(4)


@query("WITH w AS (SELECT user_id, event_type, max(ts) AS seen FROM events GROUP BY ALL) SELECT event_type, count(*) AS workers, count(*) FILTER (seen >= (SELECT max(ts) FROM events) - INTERVAL 24 HOURS) AS online, max(seen) AS last_seen FROM w GROUP BY 1")
def ag26_worker_rollup(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    w = e.groupBy("user_id", "event_type").agg(F.max("ts").alias("seen"))
    online = F.col("seen") >= e.agg(F.max("ts")).scalar() - F.expr("INTERVAL 24 HOURS")
    return w.withColumn("online", online).groupBy("event_type").agg(F.count("*").alias("workers"), F.count_if("online").alias("online"), F.max("seen").alias("last_seen"))


@query("SELECT count(*) FILTER (event_type IN ('view', 'click') AND ts >= t - INTERVAL 168 HOURS) AS active, count(*) FILTER (event_type = 'purchase' AND ts >= t - INTERVAL 168 HOURS) AS finished FROM events, (SELECT max(ts) AS t FROM events)")
def ag27_window_counts(s: SparkSession, d: str, hours: int = 168) -> DataFrame:
    e = table(s, d, "events")
    inside = e.where(F.col("ts") >= e.agg(F.max("ts")).scalar() - F.expr(f"INTERVAL {hours} HOURS"))
    return inside.agg(F.count_if(F.col("event_type").isin("view", "click")).alias("active"), F.count_if(F.col("event_type") == "purchase").alias("finished"))


@query("SELECT o_orderstatus, count(DISTINCT o_orderkey) AS jobs, count(*) AS weight, round(sum(l_quantity), 2) AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def ag28_weighted_progress(s: SparkSession, d: str) -> DataFrame:
    per = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("w"), F.sum("l_quantity").alias("q"))
    return table(s, d, "orders").join(per, "o_orderkey").groupBy("o_orderstatus").agg(F.count("*").alias("jobs"), F.sum("w").alias("weight"), F.round(F.sum("q"), 2).alias("quantity"))


@query("""WITH p AS (SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, date_diff('second', min(o_orderdate), max(o_orderdate)) AS elapsed FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN done > 0 THEN CAST(ceil(elapsed / done * (total - done)) AS BIGINT) END AS seconds_left FROM p""")
def ag29_time_left(s: SparkSession, d: str) -> DataFrame:
    sec = lambda c: c.cast("timestamp").cast("long")
    p = table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), (sec(F.max("o_orderdate")) - sec(F.min("o_orderdate"))).alias("elapsed"))
    left = F.ceil(F.col("elapsed") / F.col("done") * (F.col("total") - F.col("done")))
    return p.select("o_custkey", F.when(F.col("done") > 0, left).alias("seconds_left"))


@query("""WITH e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM (SELECT label, list_transform(embedding, lambda v: CAST(v AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda w: CAST(w AS DOUBLE) * w)))) AS embedding FROM embeddings)),
m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY ALL), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY 1) SELECT m.label, CAST(m.i AS INTEGER) AS dim, round(m.x / n.n, 5) AS x FROM m JOIN n USING (label)""")
def ag30_centroids(s: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.groups import centroids

    c = centroids(table(s, d, "embeddings"), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("p", "x")).select("label", (F.col("p") + 1).alias("dim"), F.round("x", 5).alias("x"))


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda w: CAST(w AS DOUBLE) * w)))) AS v FROM embeddings),
u AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e), m AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS x FROM u GROUP BY ALL) GROUP BY 1)
SELECT label, vec_id FROM (SELECT e.label, e.vec_id, row_number() OVER (PARTITION BY e.label ORDER BY round(list_cosine_similarity(e.v, m.c), 8) DESC, e.vec_id) AS k FROM e JOIN m USING (label)) WHERE k = 1""")
def ag31_medoids(s: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.groups import medoids

    return medoids(table(s, d, "embeddings"), "label", "vec_id", "embedding").select("label", "vec_id")


@query(f"""WITH e AS (SELECT playlist_id, key, min(name) AS name, count(DISTINCT event_id) AS n FROM ({_ENTITY}) WHERE key IS NOT NULL GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY playlist_id ORDER BY n DESC, key) AS r FROM e),
t AS (SELECT playlist_id, event_type, count(*) AS n FROM event_record GROUP BY ALL), tt AS (SELECT playlist_id, coalesce(event_type, 'other') AS event_type FROM (SELECT *, row_number() OVER (PARTITION BY playlist_id ORDER BY n DESC, event_type) AS r FROM t) WHERE r = 1)
SELECT tt.playlist_id, left(concat_ws(' · ', (SELECT string_agg(name, ' · ' ORDER BY r) FROM k WHERE k.playlist_id = tt.playlist_id AND r <= 2), tt.event_type), 120) AS label FROM tt WHERE tt.playlist_id IS NOT NULL""")
def ag32_modal_label(s: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.groups import modal_labels

    r = table(s, d, "event_record").where("playlist_id IS NOT NULL")
    e = _entities(s, d).where("key IS NOT NULL AND playlist_id IS NOT NULL").groupBy("playlist_id", "key").agg(F.min("name").alias("name"), F.countDistinct("event_id").alias("n"))
    return modal_labels(e, r, "playlist_id")


@query("""WITH x AS (SELECT e.key, e.role, count(*) AS n FROM (SELECT unnest(entities) AS e FROM event_record) GROUP BY ALL)
SELECT key, list(role || ':' || n ORDER BY n DESC, role) AS roles FROM x WHERE key IS NOT NULL AND role IS NOT NULL GROUP BY 1""")
def ag33_roles_per_entity(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "event_record").select(F.explode("entities").alias("e")).groupBy("e.key", "e.role").agg(F.count("*").alias("n")).where("key IS NOT NULL AND role IS NOT NULL")
    roles = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "role", "n")))
    return x.groupBy("key").agg(F.transform(roles, lambda r: F.concat(r["role"], F.lit(":"), r["n"].cast("string"))).alias("roles"))


@query("SELECT snapshot_id, round(min(x), 4) AS x0, round(max(x), 4) AS x1, round(min(y), 4) AS y0, round(max(y), 4) AS y1, round(min(z), 4) AS z0, round(max(z), 4) AS z1 FROM event_map_canonical GROUP BY 1")
def ag34_bounding_box(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "event_map_canonical")
    return c.groupBy("snapshot_id").agg(*[F.round(f(a), 4).alias(f"{a}{i}") for a in "xyz" for i, f in enumerate((F.min, F.max))])


@query("""WITH c AS (SELECT DISTINCT snapshot_id, event_type, canonical_id, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z FROM event_map_canonical WHERE event_type IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL),
m AS (SELECT snapshot_id, event_type, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM c GROUP BY ALL)
SELECT snapshot_id, event_type, round(any_value(mx), 4) AS cx, round(max(sqrt((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2)), 4) AS radius, count(*) AS n FROM c JOIN m USING (snapshot_id, event_type) GROUP BY ALL""")
def ag35_topic_geometry(s: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.groups import geometry

    c = table(s, d, "event_map_canonical").dropna(subset=["event_type", "x", "y", "z"]).select("snapshot_id", "event_type", "canonical_id", "x", "y", "z").distinct()
    g = geometry(c, ["snapshot_id", "event_type"])
    return g.select("snapshot_id", "event_type", F.round("cx", 4).alias("cx"), F.round("radius", 4).alias("radius"), "n")


@query("""WITH c AS (SELECT DISTINCT snapshot_id, event_type, canonical_id, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z FROM event_map_canonical WHERE event_type IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL),
m AS (SELECT snapshot_id, event_type, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM c GROUP BY ALL)
SELECT snapshot_id, event_type, arg_min(canonical_id, (round((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2, 9), canonical_id)) AS anchor FROM c JOIN m USING (snapshot_id, event_type) GROUP BY ALL""")
def ag35_topic_anchor(s: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.groups import geometry

    c = table(s, d, "event_map_canonical").dropna(subset=["event_type", "x", "y", "z"]).select("snapshot_id", "event_type", "canonical_id", "x", "y", "z").distinct()
    return geometry(c, ["snapshot_id", "event_type"], "canonical_id").select("snapshot_id", "event_type", "anchor")


@query("""WITH m AS (SELECT DISTINCT c.canonical_id, r.event_id, r.start_day, r.end_day FROM event_to_canonical c JOIN event_record r USING (event_id) WHERE c.canonical_id IS NOT NULL AND r.start_day IS NOT NULL AND r.end_day IS NOT NULL),
g AS (SELECT canonical_id, max(start_day) AS a, min(end_day) AS b, arg_min(start_day, event_id) AS fa, arg_min(end_day, event_id) AS fb FROM m GROUP BY 1)
SELECT canonical_id, CASE WHEN a > b THEN fa ELSE a END AS start_day, CASE WHEN a > b THEN fb ELSE b END AS end_day, a > b AS disagree FROM g""")
def ag36_interval_intersection(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "event_record").where("start_day IS NOT NULL AND end_day IS NOT NULL").select("event_id", "start_day", "end_day")
    m = table(s, d, "event_to_canonical").where("canonical_id IS NOT NULL").select("canonical_id", "event_id").join(r, "event_id").distinct()
    g = m.groupBy("canonical_id").agg(F.max("start_day").alias("a"), F.min("end_day").alias("b"), F.min_by(F.struct("start_day", "end_day"), "event_id").alias("f"))
    none = F.col("a") > F.col("b")
    return g.select("canonical_id", F.when(none, F.col("f.start_day")).otherwise(F.col("a")).alias("start_day"), F.when(none, F.col("f.end_day")).otherwise(F.col("b")).alias("end_day"), none.alias("disagree"))


@query("""SELECT c.canonical_id, e.entity_type, e.key, min(e.name) AS name, count(DISTINCT e.event_id) AS record_count FROM (SELECT DISTINCT event_id, canonical_id FROM event_to_canonical WHERE canonical_id IS NOT NULL) c
JOIN (SELECT event_id, unnest(entities, recursive := true) FROM event_record) e USING (event_id) GROUP BY ALL""")
def ag37_entity_index(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "event_to_canonical").where("canonical_id IS NOT NULL").select("event_id", "canonical_id").distinct()
    return c.join(_entities(s, d), "event_id").groupBy("canonical_id", "entity_type", "key").agg(F.min("name").alias("name"), F.countDistinct("event_id").alias("record_count"))


_DEPENDENT = [("video", "id", "media_id"), ("asset", "id", "video_id"), ("event_record", "event_id", "source_video_id"), ("video_time_evidence", "id", "video_id"), ("brief_reference", "id", "object_id")]


@query("""WITH v AS (SELECT DISTINCT id FROM video WHERE media_id IN (SELECT id FROM media WHERE provider = 'castnet'))
SELECT 'video' AS kind, count(*) AS n FROM v UNION ALL SELECT 'asset', count(DISTINCT id) FROM asset WHERE video_id IN (FROM v) UNION ALL SELECT 'event_record', count(DISTINCT event_id) FROM event_record WHERE source_video_id IN (FROM v)
UNION ALL SELECT 'video_time_evidence', count(DISTINCT id) FROM video_time_evidence WHERE video_id IN (FROM v) UNION ALL SELECT 'brief_reference', count(DISTINCT id) FROM brief_reference WHERE object_id IN (FROM v)""")
def ag38_deletion_impact(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "media").where("provider = 'castnet'").select(F.col("id").alias("media_id"))
    v = R.within(table(s, d, "video"), m, ["media_id"]).select("id").distinct()
    parts = {"video": v.agg(F.count("*").alias("n"))}
    for t, own, to in _DEPENDENT[1:]:
        parts[t] = R.within(table(s, d, t), v.withColumnRenamed("id", to), [to]).agg(F.countDistinct(own).alias("n"))
    return R.tagged_union(parts)


@query("SELECT count(DISTINCT event_id) FILTER (len(vector) = 64) AS ready, count(DISTINCT event_id) - count(DISTINCT event_id) FILTER (len(vector) = 64) AS remaining FROM event_record")
def ag39_remaining(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "event_record").agg(F.countDistinct(F.when(F.size("vector") == 64, F.col("event_id"))).alias("ready"), F.countDistinct("event_id").alias("all"))
    return r.select("ready", (F.col("all") - F.col("ready")).alias("remaining"))


@query("SELECT r.playlist_id, count(DISTINCT r.event_id) + any_value(coalesce(s.n, 0)) AS updates FROM event_record r LEFT JOIN (SELECT playlist_id, count(DISTINCT id) AS n FROM event_map_snapshot WHERE created_at > TIMESTAMP '2026-01-01' GROUP BY 1) s ON s.playlist_id = r.playlist_id WHERE r.created_at > TIMESTAMP '2026-01-01' GROUP BY 1")
def ag40_updates_since_cursor(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "event_map_snapshot").where("created_at > '2026-01-01'").groupBy("playlist_id").agg(F.countDistinct("id").alias("n"))
    r = table(s, d, "event_record").where("created_at > '2026-01-01'").groupBy("playlist_id").agg(F.countDistinct("event_id").alias("m"))
    return r.join(n, "playlist_id", "left").select("playlist_id", (F.col("m") + F.coalesce("n", F.lit(0))).alias("updates"))


@query("""WITH b AS (SELECT date_trunc('minute', min(ts)) AS a FROM events), sp AS (SELECT unnest(generate_series(a, a + INTERVAL 1439 MINUTES, INTERVAL 1 MINUTE)) AS minute FROM b), e AS (SELECT date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY 1)
SELECT sp.minute, coalesce(n, 0) AS n FROM sp LEFT JOIN e USING (minute)""")
def ag41_minute_gap_fill(s: SparkSession, d: str) -> DataFrame:
    minute = F.date_trunc("minute", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    e = table(s, d, "events")
    spine = e.agg(F.min(minute).alias("a")).select(F.explode(F.sequence("a", F.col("a") + F.expr("INTERVAL 1439 MINUTES"), F.expr("INTERVAL 1 MINUTE"))).alias("minute"))
    return R.gap_filled(e.groupBy(minute.alias("minute")).agg(F.count("*").alias("n")), "minute", spine, ["n"])


@query("SELECT source, count(*) AS total, count(*) FILTER (variant = 'raw') AS raw, count(*) FILTER (language IS NULL) AS no_language FROM (SELECT DISTINCT * FROM asset) GROUP BY ROLLUP (source)")
def ag42_grand_total(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "asset").distinct().rollup("source")
    return a.agg(F.count("*").alias("total"), F.count_if(F.col("variant") == "raw").alias("raw"), F.count_if(F.col("language").isNull()).alias("no_language"))


@query("SELECT o_orderpriority, count(*) AS n FROM (SELECT o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders WHERE o_orderstatus = 'F') WHERE k = 1 GROUP BY 1")
def ag43_failures_by_type(s: SparkSession, d: str) -> DataFrame:
    o = R.first_per_key(table(s, d, "orders").where("o_orderstatus = 'F'"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return o.groupBy("o_orderpriority").agg(F.count("*").alias("n"))


_PICK = """WITH e AS (SELECT video_id, id, source, row_number() OVER (PARTITION BY video_id ORDER BY status = 'accepted' DESC, confidence DESC NULLS LAST, updated_at DESC NULLS LAST, id DESC) AS k FROM video_time_evidence) SELECT video_id, id, source FROM e WHERE k = 1"""


@query(_PICK)
def wn01_selected_evidence(s: SparkSession, d: str) -> DataFrame:
    order = [F.expr("status = 'accepted'").desc(), F.desc_nulls_last("confidence"), F.desc_nulls_last("updated_at"), F.desc("id")]
    return R.first_per_key(table(s, d, "video_time_evidence"), ["video_id"], order).select("video_id", "id", "source")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1 AND o_orderstatus = 'F'")
def wn02_latest_failed_only(s: SparkSession, d: str) -> DataFrame:
    o = R.first_per_key(table(s, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return o.where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey")


@query("""SELECT video_id, id FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY updated_at DESC, id DESC) AS k FROM video_time_evidence) WHERE k = 1 AND status = 'rejected'
AND video_id NOT IN (SELECT video_id FROM asset WHERE type = 'transcript' AND video_id IS NOT NULL) AND video_id IN (SELECT id FROM video)""")
def wn03_latest_rejected_existing(s: SparkSession, d: str) -> DataFrame:
    e = R.first_per_key(table(s, d, "video_time_evidence"), ["video_id"], [F.desc("updated_at"), F.desc("id")]).where("status = 'rejected'")
    e = R.missing_from(e, table(s, d, "asset").where("type = 'transcript'"), ["video_id"])
    return R.within(e, table(s, d, "video").select(F.col("id").alias("video_id")), ["video_id"]).select("video_id", "id")


@query("SELECT playlist_id, source_video_id FROM (SELECT playlist_id, source_video_id, row_number() OVER (PARTITION BY playlist_id ORDER BY t, source_video_id) AS k FROM (SELECT playlist_id, source_video_id, min(created_at) AS t FROM event_record GROUP BY ALL)) WHERE k <= 5")
def wn04_first_n_per_group(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "event_record").groupBy("playlist_id", "source_video_id").agg(F.min("created_at").alias("t"))
    return R.first_per_key(r, ["playlist_id"], [F.col("t"), F.asc_nulls_last("source_video_id")], 5).select("playlist_id", "source_video_id")


@query("SELECT video_id, type, id FROM (SELECT *, row_number() OVER (PARTITION BY video_id, type ORDER BY created_at DESC, id DESC) AS k FROM (SELECT DISTINCT * FROM asset)) WHERE k = 1")
def wn05_latest_per_pair(s: SparkSession, d: str) -> DataFrame:
    return R.first_per_key(table(s, d, "asset").distinct(), ["video_id", "type"], [F.desc("created_at"), F.desc("id")]).select("video_id", "type", "id")


@query("SELECT brief_id, arg_max(id, (position, id)) AS last_id FROM brief_reference GROUP BY 1")
def wn06_last_member(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "brief_reference").groupBy("brief_id").agg(F.max_by("id", F.struct("position", "id")).alias("last_id"))


@query("SELECT snapshot_id, canonical_id, CAST(row_number() OVER (PARTITION BY snapshot_id ORDER BY event_start_day NULLS FIRST, canonical_id) - 1 AS INTEGER) AS canonical_rank FROM (SELECT DISTINCT snapshot_id, canonical_id, event_start_day FROM event_map_canonical)")
def wn07_dense_enumeration(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "event_map_canonical").select("snapshot_id", "canonical_id", "event_start_day").distinct()
    w = Window.partitionBy("snapshot_id").orderBy("event_start_day", "canonical_id")
    return c.select("snapshot_id", "canonical_id", (F.row_number().over(w) - 1).alias("canonical_rank"))


@query("SELECT event_id, max(other_event_id) FILTER (k = 1) AS best, max(other_event_id) FILTER (k = 2) AS runner_up FROM (SELECT event_id, other_event_id, row_number() OVER (PARTITION BY event_id ORDER BY similarity DESC, other_event_id) AS k FROM event_match WHERE event_id IS NOT NULL AND other_event_id IS NOT NULL AND similarity IS NOT NULL) WHERE k <= 2 GROUP BY 1")
def wn08_best_and_runner_up(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "event_match").dropna(subset=["event_id", "other_event_id", "similarity"])
    top = R.first_per_key(m, ["event_id"], [F.desc("similarity"), F.col("other_event_id")], 2, "k")
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("other_event_id")))
    return top.groupBy("event_id").agg(pick(1).alias("best"), pick(2).alias("runner_up"))


@query("""WITH m AS (SELECT DISTINCT event_id AS a, other_event_id AS b, similarity AS w FROM event_match WHERE event_id IS NOT NULL AND other_event_id IS NOT NULL AND similarity IS NOT NULL AND event_id <> other_event_id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY w DESC, b) AS o, row_number() OVER (PARTITION BY b ORDER BY w DESC, a) AS i FROM m) SELECT a, b FROM r WHERE o <= 3 AND i <= 3""")
def wn09_degree_cap(s: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.stories import degree_capped

    m = table(s, d, "event_match").dropna(subset=["event_id", "other_event_id", "similarity"]).where("event_id <> other_event_id")
    m = m.select(F.col("event_id").alias("a"), F.col("other_event_id").alias("b"), F.col("similarity").alias("w")).distinct()
    return degree_capped(m, [], "a", "b", "w", 3).select("a", "b")


@query("SELECT day, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS total FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)")
def wn10_running_total(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return R.running_total(e, "day", "n", "total").select("day", "total")


@query("SELECT snapshot_id, canonical_id FROM event_map_canonical WHERE point_index % 7 = 0")
def wn11_stride_sample(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "event_map_canonical").where("point_index % 7 = 0").select("snapshot_id", "canonical_id")


@query("""WITH u AS (SELECT user_id, CAST(ts AS DATE) AS day, CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN NULL ELSE count(*) END AS n FROM events GROUP BY ALL),
i AS (SELECT *, count(*) FILTER (n IS NULL) OVER (PARTITION BY user_id ORDER BY day) AS isl FROM u)
SELECT user_id, day, CASE WHEN n IS NOT NULL THEN round(avg(n) OVER (PARTITION BY user_id, isl ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 2) END AS average FROM i""")
def wn12_moving_average_with_reset(s: SparkSession, d: str) -> DataFrame:
    u = table(s, d, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.when(F.count_if(F.col("event_type") == "error") > 0, None).otherwise(F.count("*")).alias("n"))
    return R.moving_average(u, ["user_id"], "day", "n", 7, "average").select("user_id", "day", "average")


@query("""WITH e AS (SELECT user_id, event_id, ts, CAST(ts AS DATE) AS day FROM events), f AS (SELECT *, CASE WHEN lag(day) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM day THEN 1 ELSE 0 END AS new FROM e)
SELECT user_id, event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS day_group FROM f""")
def wn13_consecutive_groups(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    day = F.col("ts").cast("date")
    f = table(s, d, "events").withColumn("new", F.when(F.lag(day).over(w).eqNullSafe(day), 0).otherwise(1))
    return f.select("user_id", "event_id", F.sum("new").over(w).alias("day_group"))


@query("SELECT DISTINCT id, published_at FROM video ORDER BY published_at DESC NULLS LAST, id LIMIT 50 OFFSET 20")
def sl01_ordered_page(s: SparkSession, d: str) -> DataFrame:
    return R.page_total(table(s, d, "video").select("id", "published_at").distinct(), [F.desc_nulls_last("published_at"), F.col("id")], 20, 50)[0]


@query("SELECT o_orderkey FROM orders ORDER BY CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END, o_orderdate DESC, o_orderkey DESC LIMIT 60")
def sl02_state_dependent_order(s: SparkSession, d: str, mode: str = "mixed") -> DataFrame:
    done = F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)
    first = {"active": [], "done": [done.desc()], "mixed": [done]}[mode]
    return table(s, d, "orders").orderBy(*first, F.desc("o_orderdate"), F.desc("o_orderkey")).limit(60).select("o_orderkey")


_HIGHLIGHT = """WITH m AS (SELECT DISTINCT c.canonical_id, r.event_id, r.source_video_id, r.start_day, r.time_precision FROM event_to_canonical c JOIN event_record r USING (event_id) WHERE c.canonical_id IS NOT NULL AND r.time_precision IN ('day', 'second')),
g AS (SELECT canonical_id, count(DISTINCT source_video_id) AS sources, count(DISTINCT event_id) AS records, max(start_day) AS day FROM m GROUP BY 1)"""


def _highlights(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "event_record").where("time_precision IN ('day', 'second')").select("event_id", "source_video_id", "start_day")
    m = table(s, d, "event_to_canonical").where("canonical_id IS NOT NULL").select("canonical_id", "event_id").join(r, "event_id").distinct()
    return m.groupBy("canonical_id").agg(F.countDistinct("source_video_id").alias("sources"), F.countDistinct("event_id").alias("records"), F.max("start_day").alias("day"))


@query(_HIGHLIGHT + " SELECT canonical_id, sources, records FROM g ORDER BY sources DESC, records DESC, day DESC NULLS LAST, canonical_id LIMIT 30")
def sl03_evidence_ranking(s: SparkSession, d: str) -> DataFrame:
    return _highlights(s, d).orderBy(F.desc("sources"), F.desc("records"), F.desc_nulls_last("day"), "canonical_id").limit(30).select("canonical_id", "sources", "records")


@query("""WITH v AS (SELECT DISTINCT id AS source_video_id, media_id AS source FROM video), r AS (SELECT DISTINCT e.playlist_id, e.event_id, v.source, e.start_day FROM event_record e JOIN v USING (source_video_id) WHERE e.start_day IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY playlist_id, source ORDER BY start_day DESC, event_id) AS turn FROM r), p AS (SELECT *, row_number() OVER (PARTITION BY playlist_id ORDER BY turn, start_day DESC, event_id) AS place FROM k WHERE turn <= 2)
SELECT playlist_id, event_id, source, CAST(place AS INTEGER) AS place FROM p WHERE place <= 10""")
def sl04_diverse_cards(s: SparkSession, d: str) -> DataFrame:
    """At most ten cards a domain, two a source, the least used source first."""
    from tidemark.operators.groups import diverse_cards

    r = table(s, d, "event_record").where("start_day IS NOT NULL AND source_video_id IS NOT NULL")
    v = table(s, d, "video").select(F.col("id").alias("source_video_id"), F.col("media_id").alias("source")).distinct()
    return diverse_cards(r.join(v, "source_video_id").select("playlist_id", "event_id", "source", "start_day").distinct())


@query("SELECT o_orderkey FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderdate, o_orderkey DESC LIMIT 100")
def sl05_claim_order(s: SparkSession, d: str) -> DataFrame:
    rank = F.coalesce(X.lookup({"1-URGENT": 0, "2-HIGH": 1}, F.col("o_orderpriority")), F.lit(2))
    return table(s, d, "orders").orderBy(rank, F.desc("o_totalprice"), "o_orderdate", F.desc("o_orderkey")).limit(100).select("o_orderkey")


@query("WITH c AS (SELECT DISTINCT canonical_id FROM event_map_canonical) SELECT canonical_id, (SELECT count(*) FROM c) AS total, (SELECT count(*) FROM c) > 40 AS has_more FROM c ORDER BY canonical_id LIMIT 20 OFFSET 20")
def sl06_page_with_total(s: SparkSession, d: str) -> DataFrame:
    page, total = R.page_total(table(s, d, "event_map_canonical").select("canonical_id").distinct(), [F.col("canonical_id")], 20, 20)
    return page.select("canonical_id", F.lit(total).cast("long").alias("total"), F.lit(total > 40).alias("has_more"))


@query("""(SELECT 'event' AS kind, canonical_id AS id FROM (SELECT DISTINCT canonical_id, title FROM event_map_canonical WHERE title ILIKE '%bank%') ORDER BY title, canonical_id LIMIT 20)
UNION ALL (SELECT 'video', id FROM (SELECT DISTINCT id, title FROM video WHERE title ILIKE '%bank%') ORDER BY title, id LIMIT 10) UNION ALL (SELECT 'media', id FROM media WHERE name ILIKE '%a%' ORDER BY name, id LIMIT 10)""")
def sl07_capped_search(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "event_map_canonical").where(F.col("title").ilike("%bank%")).select(F.col("canonical_id").alias("id"), F.col("title").alias("t")).distinct()
    v = table(s, d, "video").where(F.col("title").ilike("%bank%")).select("id", F.col("title").alias("t")).distinct()
    m = table(s, d, "media").where(F.col("name").ilike("%a%")).select("id", F.col("name").alias("t"))
    order = [F.col("t"), F.col("id")]
    return R.capped_union({"event": (c, order, 20), "video": (v, order, 10), "media": (m, order, 10)}).select("kind", "id")


@query("WITH g AS (SELECT source_video_id AS video_id, event_id, start_day, len(evidence) AS support FROM event_record WHERE source_video_id IS NOT NULL) SELECT video_id, arg_min(event_id, (-coalesce(support, -1), event_id)) AS lead, count(DISTINCT event_id) AS n FROM g GROUP BY 1")
def sl08_group_cards(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "event_record").where("source_video_id IS NOT NULL").withColumn("support", F.coalesce(F.size("evidence"), F.lit(-1)))
    lead = F.min_by("event_id", F.struct((-F.col("support")).alias("m"), "event_id"))
    return g.groupBy(F.col("source_video_id").alias("video_id")).agg(lead.alias("lead"), F.countDistinct("event_id").alias("n"))


@query("""WITH x AS (SELECT DISTINCT id, playlist_id, status, created_at FROM event_map_snapshot), r AS (SELECT *, row_number() OVER (PARTITION BY playlist_id ORDER BY status = 'ready' DESC, created_at DESC, id) AS k FROM x)
SELECT id, status = 'ready' AND k <= 3 AS retained FROM r""")
def sl09_retention(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "event_map_snapshot").select("id", "playlist_id", "status", "created_at").distinct()
    return R.retained(x, ["playlist_id"], [F.desc("created_at"), F.col("id")], F.lit(False), F.col("status") == "ready", 3).select("id", "retained")


def _grid_sql() -> str:
    cell = ", ".join(f"least(15, greatest(0, floor(({a}::DOUBLE - {a}0::DOUBLE) / greatest({a}1::DOUBLE - {a}0::DOUBLE, 1e-6) * 16))) AS c{a}" for a in "xyz")
    away = " + ".join(f"({a} - ({a}0::DOUBLE + (c{a} + 0.5) / 16 * greatest({a}1::DOUBLE - {a}0::DOUBLE, 1e-6))::FLOAT) ** 2" for a in "xyz")
    return f"""WITH p AS (SELECT DISTINCT snapshot_id, canonical_id, x, y, z FROM event_map_canonical WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL),
b AS (SELECT *, count(*) OVER w AS n, {', '.join(f'min({a}) OVER w AS {a}0, max({a}) OVER w AS {a}1' for a in 'xyz')} FROM p WINDOW w AS (PARTITION BY snapshot_id)),
c AS (SELECT *, {cell} FROM b WHERE n > 4096),
k AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, cx, cy, cz ORDER BY {away}, canonical_id, x, y, z) = 1 AS chosen FROM c),
r AS (SELECT *, 4096 - count(*) FILTER (chosen) OVER (PARTITION BY snapshot_id) AS room FROM k),
s AS (SELECT *, greatest(1, (n - 4096 + room) // greatest(1, room)) AS step, row_number() OVER (PARTITION BY snapshot_id, chosen ORDER BY canonical_id, x, y, z) - 1 AS place FROM r)
SELECT snapshot_id, canonical_id FROM b WHERE n <= 4096 UNION ALL SELECT snapshot_id, canonical_id FROM s WHERE chosen OR (place % step = 0 AND place < step * room)"""


@query(_grid_sql())
def sl10_spatial_grid(s: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.projection import anchors

    c = table(s, d, "event_map_canonical").dropna(subset=["x", "y", "z"]).select("snapshot_id", "canonical_id", "x", "y", "z").distinct()
    return anchors(c, "snapshot_id", "canonical_id").select("snapshot_id", "canonical_id")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) ORDER BY o_orderdate, o_orderkey) AS k FROM orders WHERE o_orderstatus = 'O') WHERE k > 1")
def sl11_later_duplicates(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").where("o_orderstatus = 'O'").withColumn("m", F.trunc("o_orderdate", "month"))
    return R.later_duplicates(o, ["o_custkey", "m"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey")


@query("SELECT DISTINCT id, coalesce(published_at, created_at) AS t FROM video ORDER BY t DESC, id LIMIT 25")
def sl12_latest_by_best_time(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "video").select("id", F.coalesce("published_at", "created_at").alias("t")).distinct().orderBy(F.desc("t"), "id").limit(25)


@query("SELECT type, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM asset GROUP BY 1 ORDER BY 2 DESC, 1")
def sl13_by_bytes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "asset").groupBy("type").agg(F.sum("size_bytes").alias("bytes")).orderBy(F.desc("bytes"), "type")


@query("SELECT DISTINCT playlist_id, event_type, direction FROM event_record")
def st01_distinct_rows(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "event_record").select("playlist_id", "event_type", "direction").distinct()


@query("""SELECT 'media' AS kind, id, name AS label FROM media WHERE name ILIKE '%ra%' UNION ALL SELECT DISTINCT 'video', id, title FROM video WHERE title ILIKE '%steel%' UNION ALL SELECT DISTINCT 'event', event_id, title FROM event_record WHERE title ILIKE '%steel%'
UNION ALL SELECT DISTINCT 'canonical', canonical_id, title FROM event_map_canonical WHERE title ILIKE '%steel%' UNION ALL SELECT DISTINCT 'reference', id, label FROM brief_reference WHERE label ILIKE '%steel%'""")
def st02_tagged_union(s: SparkSession, d: str) -> DataFrame:
    hit = lambda t, i, c, q: table(s, d, t).where(F.col(c).ilike(q)).select(F.col(i).alias("id"), F.col(c).alias("label")).distinct()
    return R.tagged_union({"media": hit("media", "id", "name", "%ra%"), "video": hit("video", "id", "title", "%steel%"), "event": hit("event_record", "event_id", "title", "%steel%"), "canonical": hit("event_map_canonical", "canonical_id", "title", "%steel%"), "reference": hit("brief_reference", "id", "label", "%steel%")})


@query("""WITH o AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1), n AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders GROUP BY 1)
SELECT count(*) FILTER (o.k IS NULL) AS added, count(*) FILTER (n.k IS NULL) AS removed, count(*) FILTER (o.v <> n.v) AS changed FROM o FULL JOIN n ON o.k = n.k""")
def st03_symmetric_difference(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    version = lambda df, v: df.groupBy("o_custkey").agg(F.max("o_totalprice").alias(v))
    j = version(o.where("o_orderdate < '1997-01-01'"), "old").join(version(o, "new"), "o_custkey", "full")
    return j.agg(F.count_if(F.col("old").isNull()).alias("added"), F.count_if(F.col("new").isNull()).alias("removed"), F.count_if(F.col("old") != F.col("new")).alias("changed"))


@query("SELECT 'both' AS part, count(*) AS n FROM (SELECT source_video_id FROM event_record INTERSECT SELECT video_id FROM asset) UNION ALL SELECT 'only_records', count(*) FROM (SELECT source_video_id FROM event_record EXCEPT SELECT video_id FROM asset)")
def st04_intersect_except(s: SparkSession, d: str) -> DataFrame:
    a, b = table(s, d, "event_record").select(F.col("source_video_id").alias("id")), table(s, d, "asset").select(F.col("video_id").alias("id"))
    n = lambda df: df.agg(F.count("*").alias("n"))
    return R.tagged_union({"both": n(a.intersect(b)), "only_records": n(a.subtract(b))}, "part")


@query("""WITH t AS (SELECT DISTINCT id, tags FROM video WHERE len(tags) > 0), a AS (SELECT id, list_distinct(tags) AS t FROM t), p AS (SELECT a.id, a.t, b.t AS u FROM a JOIN (SELECT id, list_distinct(tags) AS t FROM t) b ON a.id = b.id)
SELECT id, round(len(list_intersect(t, list_slice(t, 1, 2))) / len(t), 6) AS jaccard FROM p""")
def st05_jaccard(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "video").where(F.size("tags") > 0).select("id", F.array_distinct("tags").alias("t"), "tags").distinct()
    return t.select("id", F.round(X.jaccard(F.col("t"), F.slice("t", 1, 2)), 6).alias("jaccard"))
