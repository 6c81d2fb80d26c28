"""Queries of the core operators for training data, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import late_events, orphans, snapshot_diff, timestamps
from tidemark.session import Stages, small
from tidemark.sources.tables import DAY_US, epoch_day, epoch_us, norm_id, table

#: Rows up to which the sources, and the zones by years that occur, are sent to every task.
MEDIA, INTERVALS = 100_000, 50_000
COMPARED = ["revision_id", "title", "event_type", "event_start_day", "event_end_day", "time_precision", "member_count", "has_uncertainty"]


def arrival_log(spark: SparkSession, d: str) -> DataFrame:
    video = table(spark, d, "video").select(F.lit("video").alias("src"), norm_id("id").alias("rec_id"), epoch_day("published_at").alias("event_day"), epoch_us("created_at").alias("arrived_us"))
    record = table(spark, d, "event_record").select(F.lit("event_record").alias("src"), norm_id("event_id").alias("rec_id"), F.col("start_day").alias("event_day"), epoch_us("created_at").alias("arrived_us"))
    return video.unionByName(record)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return late_events.found(late_events.LambdaView(), arrival_log(spark, d))


def p1_weekly(spark: SparkSession, d: str) -> DataFrame:
    """The weekly view after the layers have run over the whole log."""
    return late_events.LambdaView().replay(arrival_log(spark, d))[0].select("src", "week_day", *late_events.COUNTS)


def _parsed(df: DataFrame, src: str, rec: str, field: str) -> DataFrame:
    one = df.select(F.lit(src).alias("src"), norm_id(rec).alias("rec_id"), F.lit(field).alias("field"), F.col(field).alias("text"), norm_id("owner").alias("owner"))
    return timestamps.parse(one, "text")


def p2_instants(spark: SparkSession, d: str) -> DataFrame:
    """Every parsed value: src, rec_id, field, utc_us, wall_kind; values that denote no instant have a null utc_us."""
    media = table(spark, d, "media").select(norm_id("id").alias("media_id"), "time_zone").dropDuplicates(["media_id"])
    video = table(spark, d, "video").select(norm_id("id").alias("video_id"), norm_id("media_id").alias("media_id")).distinct()
    listed, evidence = table(spark, d, "video_list"), table(spark, d, "video_time_evidence")
    by_list = listed.withColumn("owner", F.col("media_id"))
    rows = _parsed(by_list, "video_list", "id", "published_at").unionByName(_parsed(by_list, "video_list", "id", "content_published_at"))
    # Only a wall time without a zone of its own needs the zone of the video's source.
    timed = _parsed(evidence.withColumn("owner", F.col("video_id")), "video_time_evidence", "id", "time_start")
    # The others get keys of their own that match nothing, so that no partition gathers them.
    needs = (F.col("ts_kind") == "wall") & F.col("ts_zone").isNull() & F.col("owner").isNotNull()
    asked = timed.withColumn("owner", F.when(needs, F.col("owner")).otherwise(F.concat(F.lit("~"), F.coalesce("rec_id", F.lit("")))))
    owned = asked.join(video.withColumnRenamed("video_id", "owner"), "owner", "left").withColumn("owner", F.col("media_id")).drop("media_id")
    st = Stages(spark, "timestamps")
    zoned = rows.unionByName(owned).join(small(media, MEDIA), F.col("owner") == media.media_id, "left")
    # Parsed once; the zones and years that occur make the table of intervals.
    parsed = st.write(zoned.select("src", "rec_id", "field", "ts_us", "ts_kind", "ts_zone", "time_zone"))
    intervals = st.write(timestamps.zone_intervals(timestamps.asked_zones(parsed, "time_zone")))
    instants = timestamps.resolve(parsed, "time_zone", small(intervals, INTERVALS)).select("src", "rec_id", "field", "utc_us", "wall_kind")
    parts = evidence.select(F.lit("video_time_evidence").alias("src"), norm_id("id").alias("rec_id"), F.lit("date_day").alias("field"), timestamps.date_parts_us(F.col("date_year"), F.col("date_month"), F.col("date_day")).alias("utc_us"), F.lit(None).cast("string").alias("wall_kind"))
    return instants.unionByName(parts)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_instants(spark, d).where("utc_us IS NOT NULL AND rec_id IS NOT NULL").select("src", "rec_id", "field", "utc_us").distinct()


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    asset, brief = table(spark, d, "asset"), table(spark, d, "brief_reference")
    pair = lambda s, c: F.concat_ws("/", F.coalesce(s, F.lit("")), c)

    def refs(df: DataFrame, src: str, kind, key) -> DataFrame:
        return df.select(F.lit(src).alias("src"), norm_id("id").alias("rec_id"), kind.alias("kind"), key.alias("key"), epoch_us("created_at").alias("made_us"))

    object_key = F.when(norm_id("object_id").isNotNull(), F.when(F.col("object_type") == "canonical", pair(norm_id("snapshot_id"), norm_id("object_id"))).otherwise(norm_id("object_id")))
    # A reference of no known type has no valid target.
    object_kind = F.when(F.col("object_type") == "source", "video").otherwise(F.coalesce("object_type", F.lit("")))
    left = (
        refs(asset, "asset.video_id", F.lit("video"), norm_id("video_id"))
        .unionByName(refs(brief, "brief_reference.object_id", object_kind, object_key))
        .unionByName(refs(brief, "brief_reference.snapshot_id", F.lit("snapshot"), norm_id("snapshot_id")))
    )
    video, snapshot = table(spark, d, "video"), table(spark, d, "event_map_snapshot")
    came = snapshot.select(norm_id("id").alias("snapshot_id"), epoch_us("created_at").alias("came_us")).groupBy("snapshot_id").agg(F.min("came_us").alias("came_us"))
    canonical = table(spark, d, "event_map_canonical").select(norm_id("snapshot_id").alias("snapshot_id"), norm_id("canonical_id").alias("canonical_id")).distinct()
    kept = F.lit(False).alias("gone")
    right = (
        video.select(F.lit("video").alias("kind"), norm_id("id").alias("key"), F.coalesce(F.col("status") == "deleted", F.lit(False)).alias("gone"), epoch_us("created_at").alias("came_us"))
        .unionByName(came.select(F.lit("snapshot").alias("kind"), F.col("snapshot_id").alias("key"), kept, "came_us"))
        .unionByName(table(spark, d, "event_record").select(F.lit("evidence").alias("kind"), norm_id("revision_id").alias("key"), kept, epoch_us("created_at").alias("came_us")))
        .unionByName(canonical.join(came, "snapshot_id", "left").select(F.lit("canonical").alias("kind"), pair(F.col("snapshot_id"), F.col("canonical_id")).alias("key"), kept, "came_us"))
    )
    return left, right


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    bad = orphans.find_orphans(*_references(spark, d))
    month = F.date_format(F.date_from_unix_date(F.floor(F.col("made_us") / DAY_US).cast("int")), "yyyy-MM")
    return bad.select("src", "rec_id", month.alias("month_key"), "ref_state")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per reference field and month."""
    return p4_found(spark, d).groupBy("src", "month_key", "ref_state").agg(F.count("*").alias("n_refs"))


def p4_runs(spark: SparkSession, d: str) -> DataFrame:
    """How far runs compress numbered parent keys: per table its keys and the runs that they make."""
    kinds = {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "supplier": "s_suppkey"}
    keys = [table(spark, d, t).select(F.lit(t).alias("kind"), F.col(c).cast("string").alias("key")).where("key IS NOT NULL").distinct() for t, c in kinds.items()]
    numbered = orphans.integer_keys(reduce(DataFrame.unionByName, keys))
    per = numbered.groupBy("kind").agg(F.count("*").alias("n_keys"))
    return per.join(orphans.key_runs(numbered).groupBy("kind").agg(F.count("*").alias("n_runs")), "kind")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = snapshot_diff.snapshot_pairs(table(spark, d, "event_map_snapshot"))
    rows = table(spark, d, "event_map_canonical").select(norm_id("snapshot_id").alias("snapshot"), norm_id("canonical_id").alias("key"), *COMPARED)
    out = snapshot_diff.diff(pairs, rows, COMPARED)
    return out.select(F.col("child").alias("snapshot_id"), F.col("key").alias("canonical_id"), "change_kind")


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return p6_found(spark, d).groupBy("snapshot_id", "change_kind").agg(F.count("*").alias("n_canonicals"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_weekly, p2_found, p4_found, p4_report, p4_runs, p6_found, p6_counts)}

_ID = "lower(trim({}, ' \t\r\n'))"
_ARRIVALS = f"""WITH log AS (
  SELECT 'video' AS src, {_ID.format('id')} AS rec_id, CAST(published_at AS DATE) - DATE '1970-01-01' AS event_day, epoch_us(created_at) AS arrived_us FROM video
  UNION ALL SELECT 'event_record', {_ID.format('event_id')}, start_day, epoch_us(created_at) FROM event_record),
rec AS (SELECT src, rec_id, min(event_day) AS event_day, min(arrived_us) AS arrived_us FROM log WHERE rec_id IS NOT NULL AND event_day IS NOT NULL AND arrived_us IS NOT NULL GROUP BY src, rec_id),
wk AS (SELECT src, rec_id, arrived_us, CAST(event_day - ((event_day + 3) % 7 + 7) % 7 AS INTEGER) AS week_day FROM rec),
o AS (SELECT src, rec_id, week_day, CASE WHEN arrived_us < (week_day + 7) * 86400000000::BIGINT THEN 'on_time' WHEN arrived_us < (week_day + 21) * 86400000000::BIGINT THEN 'corrects' ELSE 'dropped' END AS outcome FROM wk)
"""
_ORPHANS = f"""WITH v AS (SELECT {_ID.format('id')} AS k, bool_or(coalesce(status = 'deleted', false)) AS gone, min(created_at) AS came FROM video GROUP BY 1),
s AS (SELECT {_ID.format('id')} AS k, min(created_at) AS came FROM event_map_snapshot GROUP BY 1),
e AS (SELECT {_ID.format('revision_id')} AS k, min(created_at) AS came FROM event_record GROUP BY 1),
c AS (SELECT DISTINCT {_ID.format('snapshot_id')} || '/' || {_ID.format('canonical_id')} AS k, {_ID.format('snapshot_id')} AS sk FROM event_map_canonical),
t AS (SELECT 'video' AS kind, k, gone, came FROM v UNION ALL SELECT 'snapshot', k, false, came FROM s UNION ALL SELECT 'evidence', k, false, came FROM e
  UNION ALL SELECT 'canonical', c.k, false, s.came FROM c LEFT JOIN s ON c.sk = s.k),
r AS (SELECT 'asset.video_id' AS src, {_ID.format('id')} AS rec_id, 'video' AS kind, {_ID.format('video_id')} AS k, created_at FROM asset WHERE video_id IS NOT NULL
  UNION ALL SELECT 'brief_reference.object_id', {_ID.format('id')}, CASE object_type WHEN 'source' THEN 'video' ELSE object_type END,
    CASE WHEN object_type = 'canonical' THEN coalesce({_ID.format('snapshot_id')}, '') || '/' || {_ID.format('object_id')} ELSE {_ID.format('object_id')} END, created_at FROM brief_reference WHERE object_id IS NOT NULL
  UNION ALL SELECT 'brief_reference.snapshot_id', {_ID.format('id')}, 'snapshot', {_ID.format('snapshot_id')}, created_at FROM brief_reference WHERE snapshot_id IS NOT NULL),
d AS (SELECT src, rec_id, kind, k, min(created_at) AS made FROM r GROUP BY ALL),
f AS (SELECT d.src, d.rec_id, strftime(d.made, '%Y-%m') AS month_key, CASE WHEN t.k IS NULL THEN 'missing' WHEN t.gone THEN 'deleted' WHEN t.came > d.made THEN 'later' END AS ref_state
  FROM d LEFT JOIN t ON d.kind = t.kind AND d.k = t.k)
"""
_DIFF = f"""WITH s AS (SELECT {_ID.format('id')} AS id, {_ID.format('parent_snapshot_id')} AS parent, status FROM event_map_snapshot),
p AS (SELECT DISTINCT id, parent FROM s WHERE status = 'ready' AND parent IN (SELECT id FROM s)),
r AS (SELECT DISTINCT {_ID.format('snapshot_id')} AS sid, {_ID.format('canonical_id')} AS cid, {', '.join(COMPARED)} FROM event_map_canonical),
n AS (SELECT p.id AS snap, r.* FROM p JOIN r ON r.sid = p.id), o AS (SELECT p.id AS snap, r.* FROM p JOIN r ON r.sid = p.parent),
d AS (SELECT coalesce(n.snap, o.snap) AS snapshot_id, coalesce(n.cid, o.cid) AS canonical_id, CASE WHEN o.snap IS NULL THEN 'added' WHEN n.snap IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
  FROM n FULL JOIN o ON n.snap = o.snap AND n.cid = o.cid
  WHERE n.snap IS NULL OR o.snap IS NULL OR {' OR '.join(f'n.{c} IS DISTINCT FROM o.{c}' for c in COMPARED)})
"""
ORACLES: dict[str, str] = {
    "p1_found": _ARRIVALS + "SELECT src, rec_id, week_day, outcome FROM o WHERE outcome <> 'on_time'",
    "p1_weekly": _ARRIVALS + "SELECT src, week_day, count(*) FILTER (outcome = 'on_time') AS provisional, count(*) FILTER (outcome = 'corrects') AS corrections, count(*) FILTER (outcome = 'dropped') AS dropped, count(*) FILTER (outcome <> 'dropped') AS final FROM o GROUP BY ALL",
    "p4_found": _ORPHANS + "SELECT * FROM f WHERE ref_state IS NOT NULL",
    "p4_report": _ORPHANS + "SELECT src, month_key, ref_state, count(*) AS n_refs FROM f WHERE ref_state IS NOT NULL GROUP BY ALL",
    "p4_runs": " UNION ALL ".join(f"SELECT '{t}' AS kind, count(*) AS n_keys, count(*) FILTER (k % 65536 = 0 OR p IS NULL OR p <> k - 1) AS n_runs FROM (SELECT k, lag(k) OVER (ORDER BY k) AS p FROM (SELECT DISTINCT {c} AS k FROM {t} WHERE {c} IS NOT NULL))" for t, c in (("orders", "o_orderkey"), ("customer", "c_custkey"), ("part", "p_partkey"), ("supplier", "s_suppkey"))),
    "p6_found": _DIFF + "SELECT * FROM d",
    "p6_counts": _DIFF + "SELECT snapshot_id, change_kind, count(*) AS n_canonicals FROM d GROUP BY ALL",
}
