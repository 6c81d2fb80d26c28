"""Scans, filters and joins over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import times as D
from tidemark.functions import vectors as V
from tidemark.operators import relational as R
from tidemark.plans.registry import Catalog
from tidemark.session import within
from tidemark.sources.tables import norm_id, table

CATALOG = Catalog()
query = CATALOG.query
QUERIES, ORACLES = CATALOG.queries, CATALOG.oracles


@query("SELECT id, provider FROM media WHERE provider IN ('castnet', 'vidhub') ORDER BY id LIMIT 200")
def flt19_clamped_page(s: SparkSession, d: str, limit: str = "5000", providers: str = " castnet, vidhub,,castnet") -> DataFrame:
    """A page by parameters as they come in: a limit beyond bounds and a list with blanks and repeats."""
    m = table(s, d, "media").where(F.col("provider").isin(R.csv_values(providers)))
    return m.select("id", "provider").orderBy("id").limit(R.clamp_limit(limit))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
def src01_point_lookup(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").where("o_orderkey = 7").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 50")
def src02_keyset_page(s: SparkSession, d: str) -> DataFrame:
    return R.keyset_page(table(s, d, "orders"), "o_orderkey", 100, 50).select("o_orderkey", "o_custkey")


@query("SELECT id, created_at FROM asset WHERE (created_at, id) < (TIMESTAMP '2025-06-01', 'f') ORDER BY created_at DESC, id DESC LIMIT 40")
def src03_keyset_page_descending(s: SparkSession, d: str) -> DataFrame:
    from datetime import datetime

    return R.keyset_page_desc(table(s, d, "asset"), "created_at", "id", (datetime(2025, 6, 1), "f"), 40).select("id", "created_at")


@query("""SELECT v.id, list_sort(list(a.id) FILTER (a.id IS NOT NULL)) AS assets FROM (SELECT DISTINCT id FROM video) v
LEFT JOIN (SELECT DISTINCT id, video_id FROM asset) a ON a.video_id = v.id GROUP BY v.id""")
def src05_children_of_parents(s: SparkSession, d: str) -> DataFrame:
    child = table(s, d, "asset").select("id", "video_id").distinct().groupBy("video_id").agg(F.array_sort(F.collect_list("id")).alias("assets"))
    return table(s, d, "video").select("id").distinct().join(child, F.col("id") == F.col("video_id"), "left").select("id", "assets")


@query("SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '…' ELSE text END AS body FROM documents")
def src10_text_with_truncation(s: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(s, d, "documents").select("doc_id", F.when(F.length(t) > 500, F.concat(F.substring(t, 1, 500), F.lit("…"))).otherwise(t).alias("body"))


@query("SELECT DISTINCT provider_video_id, title FROM video v WHERE NOT EXISTS (SELECT 1 FROM asset a WHERE a.video_id = v.id)")
def src12_insert_if_new(s: SparkSession, d: str) -> DataFrame:
    known = table(s, d, "asset").select(F.col("video_id").alias("id"))
    return R.missing_from(table(s, d, "video"), known, ["id"]).select("provider_video_id", "title").distinct()


@query("SELECT snapshot_id, canonical_id, title, member_count, event_start_day FROM event_map_canonical WHERE member_count >= 3 AND event_start_day IS NOT NULL")
def src14_event_export(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "event_map_canonical").where("member_count >= 3 AND event_start_day IS NOT NULL").select("snapshot_id", "canonical_id", "title", "member_count", "event_start_day")


@query("SELECT snapshot_id, list_sort(list(DISTINCT point_index)) AS points FROM event_map_canonical WHERE event_type = 'policy' AND point_index IS NOT NULL GROUP BY 1")
def src16_point_index(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "event_map_canonical").where("event_type = 'policy' AND point_index IS NOT NULL")
    return c.groupBy("snapshot_id").agg(F.array_sort(F.collect_set("point_index")).alias("points"))


@query("""SELECT DISTINCT event_id, title FROM event_record r WHERE event_type IN ('policy', 'macro') AND start_day IS NOT NULL
AND created_at >= TIMESTAMP '2025-01-01' AND created_at < TIMESTAMP '2026-01-01'
AND len(list_filter(entities, lambda e: e.confidence >= 0.5 AND e.name ILIKE '%steel%')) > 0""")
def flt01_event_filter(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "event_record").where("event_type IN ('policy', 'macro') AND start_day IS NOT NULL AND created_at >= '2025-01-01' AND created_at < '2026-01-01'")
    hit = F.exists("entities", lambda e: (e["confidence"] >= 0.5) & e["name"].ilike("%steel%"))
    return r.where(hit).select("event_id", "title").distinct()


@query("SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1")
def flt02_half_open_window(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").where("ts >= '2024-01-10' AND ts < '2024-01-20'").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT snapshot_id, count(DISTINCT canonical_id) AS n FROM event_map_canonical WHERE event_end_day >= 20200 AND event_start_day <= 20300 GROUP BY 1")
def flt03_interval_overlap(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "event_map_canonical").where(R.overlaps(F.col("event_start_day"), F.col("event_end_day"), 20200, 20300))
    return c.groupBy("snapshot_id").agg(F.countDistinct("canonical_id").alias("n"))


@query("SELECT status, count(*) AS n FROM video WHERE title ILIKE '%b_nk%' OR description ILIKE '%b_nk%' GROUP BY 1")
def flt04_contains_any_column(s: SparkSession, d: str) -> DataFrame:
    hit = F.col("title").ilike("%b_nk%") | F.col("description").ilike("%b_nk%")
    return table(s, d, "video").where(hit).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT status, count(*) AS n FROM video WHERE media_id IN (SELECT id FROM media WHERE provider = 'vidhub') GROUP BY 1")
def flt05_in_scope(s: SparkSession, d: str) -> DataFrame:
    scope = table(s, d, "media").where("provider = 'vidhub'").select(F.col("id").alias("media_id"))
    return R.within(table(s, d, "video"), scope, ["media_id"]).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT id FROM video v WHERE EXISTS (SELECT 1 FROM asset a WHERE a.video_id = v.id AND a.type = 'transcript') AND EXISTS (SELECT 1 FROM asset a WHERE a.video_id = v.id AND a.type = 'video')")
def flt06_exists(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "asset").withColumnRenamed("video_id", "vid").select("vid", "type").withColumnRenamed("vid", "id")
    v = R.within(table(s, d, "video").select("id"), a.where("type = 'transcript'"), ["id"])
    return R.within(v, a.where("type = 'video'"), ["id"]).distinct()


@query("SELECT status, count(*) AS n FROM video v WHERE NOT EXISTS (SELECT 1 FROM asset a WHERE a.video_id = v.id) GROUP BY 1")
def flt07_not_exists(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "asset").select(F.col("video_id").alias("id"))
    return R.missing_from(table(s, d, "video"), a, ["id"]).groupBy("status").agg(F.count("*").alias("n"))


_NINE = ["revision_id", "title", "event_type", "event_start_day", "event_end_day", "time_precision", "member_count", "has_uncertainty", "point_index"]


@query(f"""SELECT s.id AS snapshot_id, count(DISTINCT n.canonical_id) AS n FROM event_map_snapshot s JOIN event_map_canonical n ON n.snapshot_id = s.id
JOIN event_map_canonical o ON o.snapshot_id = s.parent_snapshot_id AND o.canonical_id = n.canonical_id WHERE {' OR '.join(f'n.{c} IS DISTINCT FROM o.{c}' for c in _NINE)} GROUP BY 1""")
def flt08_null_safe_difference(s: SparkSession, d: str) -> DataFrame:
    snap, c = table(s, d, "event_map_snapshot"), table(s, d, "event_map_canonical").select("snapshot_id", "canonical_id", *_NINE)
    n = c.join(snap.select(F.col("id").alias("snapshot_id"), "parent_snapshot_id"), "snapshot_id").alias("n")
    o = c.alias("o")
    both = n.join(o, (F.col("o.snapshot_id") == F.col("n.parent_snapshot_id")) & (F.col("o.canonical_id") == F.col("n.canonical_id")))
    changed = both.where(R.differs([(F.col(f"n.{x}"), F.col(f"o.{x}")) for x in _NINE]))
    return changed.groupBy(F.col("n.snapshot_id").alias("snapshot_id")).agg(F.countDistinct("n.canonical_id").alias("n"))


@query("SELECT event_type, count(*) AS n FROM events WHERE CAST(props->>'$.k' AS INTEGER) >= 50 GROUP BY 1")
def flt09_json_path(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").where(F.get_json_object("props", "$.k").try_cast("int") >= 50).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT list(id) AS ids FROM (SELECT DISTINCT id FROM video WHERE view_count >= 5000))
SELECT DISTINCT event_id, list_min(list_intersect(list_transform(evidence, lambda e: e.video_id), ids)) AS video_id FROM event_record, w WHERE list_has_any(list_transform(evidence, lambda e: e.video_id), ids)""")
def flt10_array_containment(s: SparkSession, d: str) -> DataFrame:
    wanted = table(s, d, "video").where("view_count >= 5000").select(F.col("id").alias("video_id")).distinct()
    cited = table(s, d, "event_record").select("event_id", F.explode("evidence.video_id").alias("video_id"))
    return R.within(cited, wanted, ["video_id"]).groupBy("event_id").agg(F.min("video_id").alias("video_id"))


@query("SELECT DISTINCT id, list_filter(list_transform(string_split(title, ','), lambda x: trim(x)), lambda x: x <> '') AS parts FROM video WHERE title IS NOT NULL")
def flt11_list_of_values(s: SparkSession, d: str) -> DataFrame:
    parts = F.filter(F.transform(F.split("title", ","), lambda x: F.trim(x)), lambda x: x != "")
    return table(s, d, "video").where("title IS NOT NULL").select("id", parts.alias("parts")).distinct()


@query(r"SELECT id, CASE WHEN regexp_full_match(time_start, '\d{4}-\d{2}-\d{2}') THEN TRY_CAST(time_start AS DATE) END AS day FROM video_time_evidence WHERE time_start IS NOT NULL")
def flt12_safe_cast(s: SparkSession, d: str) -> DataFrame:
    t = F.col("time_start")
    return table(s, d, "video_time_evidence").where(t.isNotNull()).select("id", F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & ~t.rlike("\n"), t.try_cast("date")).alias("day"))


@query("SELECT CASE precision WHEN 'second' THEN 4 WHEN 'day' THEN 3 WHEN 'month' THEN 2 WHEN 'year' THEN 1 ELSE 0 END AS precision_rank, count(*) AS n FROM video_time_evidence GROUP BY 1")
def flt13_case_projection(s: SparkSession, d: str) -> DataFrame:
    from tidemark.functions.vocab import PRECISION

    rank = F.coalesce(X.lookup(PRECISION, F.col("precision")), F.lit(0)).alias("precision_rank")
    return table(s, d, "video_time_evidence").groupBy(rank).agg(F.count("*").alias("n"))


@query("""SELECT playlist_id, count(DISTINCT event_id) AS n FROM event_record WHERE start_day IS NOT NULL AND len(vector) = 64
AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY 1""")
def flt14_visible_records(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "event_record").where(F.col("start_day").isNotNull() & V.valid(F.col("vector"), 64))
    return r.groupBy("playlist_id").agg(F.countDistinct("event_id").alias("n"))


@query("""WITH c AS (SELECT DISTINCT snapshot_id, canonical_id, CASE WHEN member_count >= 4 THEN 'established' ELSE 'emerging' END AS maturity, has_uncertainty FROM event_map_canonical WHERE member_count IS NOT NULL)
SELECT 'all' AS scope, count(*) AS n FROM c UNION ALL SELECT 'established', count(*) FILTER (maturity = 'established') FROM c UNION ALL SELECT 'emerging', count(*) FILTER (maturity = 'emerging') FROM c
UNION ALL SELECT 'attention', count(*) FILTER (maturity = 'established' AND NOT coalesce(has_uncertainty, false)) FROM c""")
def flt15_scope_filter(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "event_map_canonical").where("member_count IS NOT NULL")
    c = c.select("snapshot_id", "canonical_id", F.when(F.col("member_count") >= 4, "established").otherwise("emerging").alias("maturity"), "has_uncertainty").distinct()
    sure = ~F.coalesce(F.col("has_uncertainty"), F.lit(False))
    inside = F.array_compact(F.array(F.lit("all"), F.col("maturity"), F.when((F.col("maturity") == "established") & sure, F.lit("attention"))))
    return c.select(F.explode(inside).alias("scope")).groupBy("scope").agg(F.count("*").alias("n"))


@query("SELECT m.id, m.name, count(v.id) AS n FROM media m LEFT JOIN (SELECT DISTINCT id, media_id FROM video WHERE status <> 'deleted') v ON v.media_id = m.id WHERE m.provider = 'tubely' GROUP BY ALL")
def flt16_domain_or_global_scope(s: SparkSession, d: str, provider: str | None = "tubely") -> DataFrame:
    m = table(s, d, "media")
    m = m.where(F.col("provider") == provider) if provider else m
    v = table(s, d, "video").where("status <> 'deleted'").select(F.col("id").alias("vid"), F.col("media_id").alias("mid")).distinct()
    return m.join(v, F.col("mid") == F.col("id"), "left").groupBy("id", "name").agg(F.count("vid").alias("n"))


@query("""SELECT snapshot_id, CASE WHEN NOT (event_end_day >= 20200 AND event_start_day <= 20400) THEN 0 WHEN event_type <> 'policy' THEN 1 WHEN member_count < 3 THEN 2 ELSE 3 END AS category, count(*) AS n
FROM event_map_canonical WHERE event_start_day IS NOT NULL AND event_end_day IS NOT NULL AND event_type IS NOT NULL AND member_count IS NOT NULL GROUP BY ALL""")
def flt17_scene_mask(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "event_map_canonical").dropna(subset=["event_start_day", "event_end_day", "event_type", "member_count"])
    inside = R.overlaps(F.col("event_start_day"), F.col("event_end_day"), 20200, 20400)
    category = F.when(~inside, 0).when(F.col("event_type") != "policy", 1).when(F.col("member_count") < 3, 2).otherwise(3)
    return c.groupBy("snapshot_id", category.alias("category")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM event_map_canonical WHERE event_end_day >= 20200 AND event_start_day <= 20400 AND event_type IN ('policy', 'fx')")
def flt18_visible_count(s: SparkSession, d: str) -> DataFrame:
    inside = R.overlaps(F.col("event_start_day"), F.col("event_end_day"), 20200, 20400)
    return table(s, d, "event_map_canonical").where(inside & F.col("event_type").isin("policy", "fx")).agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT v.id FROM video v JOIN media m ON m.id = v.media_id WHERE m.provider = 'castnet' AND v.status = 'discovered'
AND v.id NOT IN (SELECT video_id FROM asset WHERE type = 'video' AND video_id IS NOT NULL) AND v.id NOT IN (SELECT video_id FROM video_time_evidence WHERE status = 'candidate' AND video_id IS NOT NULL)""")
def flt20_cleanup_candidates(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "media").where("provider = 'castnet'").select(F.col("id").alias("media_id"))
    v = R.within(table(s, d, "video").where("status = 'discovered'"), m, ["media_id"]).select("id")
    v = R.missing_from(v, table(s, d, "asset").where("type = 'video'").select(F.col("video_id").alias("id")), ["id"])
    return R.missing_from(v, table(s, d, "video_time_evidence").where("status = 'candidate'").select(F.col("video_id").alias("id")), ["id"]).distinct()


@query("SELECT playlist_id, count(DISTINCT event_id) AS n FROM event_record WHERE len(list_filter(evidence, lambda e: e.confidence >= 0.8)) > 0 GROUP BY 1")
def flt21_verified_evidence(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "event_record").where(F.exists("evidence", lambda e: e["confidence"] >= 0.8))
    return r.groupBy("playlist_id").agg(F.countDistinct("event_id").alias("n"))


@query("SELECT canonical_id, point_index, event_start_day FROM event_map_canonical WHERE snapshot_id < '2'")
def flt22_hot_columns(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "event_map_canonical").where("snapshot_id < '2'").select("canonical_id", "point_index", "event_start_day")


@query("""SELECT DISTINCT id, published_at FROM video v WHERE status IN ('discovered', 'failed') AND NOT EXISTS (SELECT 1 FROM asset a WHERE a.video_id = v.id) AND NOT EXISTS (SELECT 1 FROM video_time_evidence e WHERE e.video_id = v.id)""")
def flt23_eligible_existing(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "video").where("status IN ('discovered', 'failed')")
    for t in ("asset", "video_time_evidence"):
        v = R.missing_from(v, table(s, d, t).select(F.col("video_id").alias("id")), ["id"])
    return v.select("id", "published_at").distinct().orderBy(F.desc_nulls_last("published_at"), "id")


@query("SELECT CASE WHEN status IN ('deleted', 'failed') THEN 'unavailable' WHEN regexp_matches(lower(title), 'port|hafen|puerto') THEN 'restricted' ELSE 'open' END AS availability, count(*) AS n FROM video GROUP BY 1")
def flt24_availability(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("status").isin("deleted", "failed"), "unavailable").when(F.lower("title").rlike("port|hafen|puerto"), "restricted").otherwise("open")
    return table(s, d, "video").groupBy(kind.alias("availability")).agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT video_id FROM asset WHERE type = 'transcript' AND format = 'json' AND variant = 'raw' AND source = 'platform' AND language = 'en' AND size_bytes < 50000
AND video_id NOT IN (SELECT id FROM video WHERE status = 'failed')""")
def flt25_defective_assets(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "asset").where("type = 'transcript' AND format = 'json' AND variant = 'raw' AND source = 'platform' AND language = 'en' AND size_bytes < 50000 AND video_id IS NOT NULL")
    busy = table(s, d, "video").where("status = 'failed'").select(F.col("id").alias("video_id"))
    return R.missing_from(a.select("video_id").distinct(), busy, ["video_id"])


@query("SELECT type, count(*) AS n FROM asset WHERE regexp_matches(concat_ws(' ', type, format, variant, source, language), 'srt|mp4 raw') GROUP BY 1")
def flt26_regex_over_columns(s: SparkSession, d: str) -> DataFrame:
    joined = F.concat_ws(" ", "type", "format", "variant", "source", "language")
    return table(s, d, "asset").where(joined.rlike("srt|mp4 raw")).groupBy("type").agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT event_id, len(list_filter(entities, lambda e: e.confidence >= 0.5)) * 2 <= len(evidence) AS saturated FROM event_record WHERE entities IS NOT NULL AND evidence IS NOT NULL""")
def flt27_saturation(s: SparkSession, d: str) -> DataFrame:
    ready = F.size(F.filter("entities", lambda e: e["confidence"] >= 0.5))
    r = table(s, d, "event_record").where("entities IS NOT NULL AND evidence IS NOT NULL")
    return r.select("event_id", (ready * 2 <= F.size("evidence")).alias("saturated")).distinct()


@query("SELECT m.provider, count(DISTINCT r.event_id) AS n FROM event_record r JOIN video v ON v.id = r.source_video_id JOIN media m ON m.id = v.media_id GROUP BY 1")
def jn01_join_chain(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "video").select(F.col("id").alias("source_video_id"), "media_id").distinct()
    m = table(s, d, "media").select(F.col("id").alias("media_id"), "provider")
    r = table(s, d, "event_record").select("event_id", "source_video_id")
    # media is a fixed table.
    return r.join(v, "source_video_id").join(m, "media_id").groupBy("provider").agg(F.countDistinct("event_id").alias("n"))


@query("SELECT v.status, count(*) AS n, count(a.id) AS with_raw FROM (SELECT DISTINCT id, status FROM video) v LEFT JOIN (SELECT video_id, min(id) AS id FROM asset WHERE type = 'transcript' AND variant = 'raw' GROUP BY 1) a ON a.video_id = v.id GROUP BY 1")
def jn02_left_join_conditions(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "asset").where("type = 'transcript' AND variant = 'raw'").groupBy(F.col("video_id").alias("vid")).agg(F.min("id").alias("aid"))
    v = table(s, d, "video").select("id", "status").distinct()
    return v.join(a, F.col("vid") == F.col("id"), "left").groupBy("status").agg(F.count("*").alias("n"), F.count("aid").alias("with_raw"))


@query("SELECT c.snapshot_id, count(*) AS n FROM (SELECT DISTINCT snapshot_id, canonical_id FROM event_map_canonical) c JOIN (SELECT DISTINCT snapshot_id, canonical_id, event_id FROM event_to_canonical) e USING (snapshot_id, canonical_id) GROUP BY 1")
def jn03_composite_key(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "event_map_canonical").select("snapshot_id", "canonical_id").distinct()
    e = table(s, d, "event_to_canonical").select("snapshot_id", "canonical_id", "event_id").distinct()
    return c.join(e, ["snapshot_id", "canonical_id"]).groupBy("snapshot_id").agg(F.count("*").alias("n"))


@query("SELECT n.n_name, r.r_name, count(c.c_custkey) AS customers, (SELECT count(*) FROM supplier s WHERE s.s_nationkey = n.n_nationkey) AS suppliers FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY n.n_nationkey, n.n_name, r.r_name")
def jn04_two_level_self_join(s: SparkSession, d: str) -> DataFrame:
    n, r = table(s, d, "nation"), table(s, d, "region")
    c = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    p = table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    out = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).join(c, "n_nationkey", "left").join(p, "n_nationkey", "left")
    return out.select("n_name", "r_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("""SELECT s.id AS snapshot_id, count(*) FILTER (o.canonical_id IS NULL) AS fresh, count(*) FILTER (o.canonical_id IS NOT NULL) AS kept FROM event_map_snapshot s
JOIN (SELECT DISTINCT snapshot_id, canonical_id FROM event_map_canonical) n ON n.snapshot_id = s.id LEFT JOIN (SELECT DISTINCT snapshot_id, canonical_id FROM event_map_canonical) o ON o.snapshot_id = s.parent_snapshot_id AND o.canonical_id = n.canonical_id GROUP BY 1""")
def jn05_version_self_join(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "event_map_canonical").select("snapshot_id", "canonical_id").distinct()
    n = c.join(table(s, d, "event_map_snapshot").select(F.col("id").alias("snapshot_id"), F.col("parent_snapshot_id").alias("parent")), "snapshot_id")
    both = n.join(c.select(F.col("snapshot_id").alias("parent"), "canonical_id", F.lit(1).alias("was")), ["parent", "canonical_id"], "left")
    return both.groupBy("snapshot_id").agg(F.count_if(F.col("was").isNull()).alias("fresh"), F.count_if(F.col("was").isNotNull()).alias("kept"))


@query("SELECT DISTINCT r.event_id, r.source_video_id IS NOT NULL AS has_source FROM event_record r LEFT JOIN event_to_canonical e ON e.event_id = r.event_id AND e.canonical_id IS NOT NULL WHERE e.event_id IS NULL")
def jn06_missing_targets(s: SparkSession, d: str) -> DataFrame:
    done = table(s, d, "event_to_canonical").where("canonical_id IS NOT NULL")
    r = R.missing_from(table(s, d, "event_record").select("event_id", "source_video_id"), done, ["event_id"])
    return r.select("event_id", F.col("source_video_id").isNotNull().alias("has_source")).distinct()


@query("SELECT count(DISTINCT event_id) AS n FROM event_record WHERE source_video_id IN (SELECT video_id FROM asset WHERE type = 'transcript')")
def jn07_semi_join(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "asset").where("type = 'transcript'").select(F.col("video_id").alias("source_video_id"))
    return R.within(table(s, d, "event_record"), a, ["source_video_id"]).agg(F.countDistinct("event_id").alias("n"))


@query("SELECT (SELECT count(DISTINCT id) FROM video) AS videos, (SELECT count(DISTINCT event_id) FROM event_record) AS records, (SELECT count(DISTINCT id) FROM event_map_snapshot WHERE status = 'ready') AS ready")
def jn08_scalars_side_by_side(s: SparkSession, d: str) -> DataFrame:
    one = lambda t, c, n, w="true": table(s, d, t).where(w).agg(F.countDistinct(c)).scalar().alias(n)
    return s.range(1).select(one("video", "id", "videos"), one("event_record", "event_id", "records"), one("event_map_snapshot", "id", "ready", "status = 'ready'"))


@query("SELECT o_orderkey, l_linenumber, l_partkey FROM (SELECT o_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS k FROM orders JOIN lineitem ON l_orderkey = o_orderkey) WHERE k = 1")
def jn09_first_match(s: SparkSession, d: str) -> DataFrame:
    j = table(s, d, "orders").join(table(s, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return R.first_per_key(j, ["o_orderkey"], [F.desc("l_extendedprice"), F.col("l_linenumber")]).select("o_orderkey", "l_linenumber", "l_partkey")


@query("SELECT r.event_id, max(v.published_at) AS latest FROM (SELECT DISTINCT event_id, unnest(list_transform(evidence, lambda e: e.video_id)) AS video_id FROM event_record) r JOIN video v ON v.id = r.video_id GROUP BY 1")
def jn10_unnest_join_max(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "event_record").select("event_id", F.explode("evidence.video_id").alias("id")).distinct()
    return e.join(table(s, d, "video").select("id", "published_at"), "id").groupBy("event_id").agg(F.max("published_at").alias("latest"))


@query("SELECT c.c_nationkey, count(*) AS n FROM events e JOIN customer c ON c.c_custkey = CAST(e.props->>'$.k' AS BIGINT) GROUP BY 1")
def jn11_join_on_json_key(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select(F.get_json_object("props", "$.k").try_cast("long").alias("c_custkey"))
    return e.join(table(s, d, "customer"), "c_custkey").groupBy("c_nationkey").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT v.id, (SELECT max(a.created_at) FROM asset a WHERE a.video_id = v.id) AS last_asset FROM video v")
def jn12_correlated_scalar(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "asset").groupBy(F.col("video_id").alias("id")).agg(F.max("created_at").alias("last_asset"))
    return table(s, d, "video").select("id").distinct().join(a, "id", "left")


_TIMELINE = """WITH e AS (SELECT video_id, id, source, confidence, make_date(date_year, date_month, date_day) AS day, row_number() OVER (PARTITION BY video_id ORDER BY status = 'accepted' DESC, confidence DESC NULLS LAST, updated_at DESC NULLS LAST, id DESC) AS k
FROM video_time_evidence WHERE status <> 'rejected' AND date_year IS NOT NULL AND date_month BETWEEN 1 AND 12 AND date_day BETWEEN 1 AND 28) """


def _evidence(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "video_time_evidence").where("status <> 'rejected' AND date_year IS NOT NULL AND date_month BETWEEN 1 AND 12 AND date_day BETWEEN 1 AND 28")
    return e.withColumn("day", F.make_date("date_year", "date_month", "date_day"))


def evidence_order() -> list:
    return [F.expr("status = 'accepted'").desc(), F.desc_nulls_last("confidence"), F.desc_nulls_last("updated_at"), F.desc("id")]


@query(_TIMELINE + "SELECT DISTINCT v.id, e.day, e.source FROM video v LEFT JOIN e ON e.video_id = v.id AND e.k = 1")
def jn13_selected_row_join(s: SparkSession, d: str) -> DataFrame:
    base = table(s, d, "video").select("id").distinct()
    return R.with_selected(base, "id", _evidence(s, d).select(F.col("video_id").alias("vid"), "*").withColumnRenamed("id", "eid").withColumnRenamed("vid", "id"), [F.expr("status = 'accepted'").desc(), F.desc_nulls_last("confidence"), F.desc_nulls_last("updated_at"), F.desc("eid")], ["day", "source"])


@query("SELECT o_orderpriority, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0 GROUP BY 1")
def jn14_hash_join_hint(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")).hint("shuffle_hash")
    return table(s, d, "orders").join(c, "o_custkey").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0 GROUP BY 1")
def jn14_within_ten_seconds(s: SparkSession, d: str, seconds: float = 10.0) -> DataFrame:
    """The same, run under the timeout of a ranking statement: its few rows come back, or TimeoutError."""
    df = jn14_hash_join_hint(s, d)
    return s.createDataFrame(within(s, seconds, df.collect), df.schema)


@query("SELECT DISTINCT v.id, m.name, m.provider FROM video v LEFT JOIN media m ON m.id = v.media_id")
def jn15_lookup_join(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "media").select(F.col("id").alias("media_id"), "name", "provider")
    return table(s, d, "video").join(m, "media_id", "left").select("id", "name", "provider").distinct()


@query("""WITH p AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
SELECT a.event_id AS source, b.event_id AS target, CAST(b.k - a.k AS INTEGER) AS steps FROM p a JOIN p b ON a.user_id = b.user_id AND b.k > a.k AND b.k <= a.k + 8 WHERE date_diff('day', a.ts, b.ts) <= 30""")
def jn16_look_ahead(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("user_id", F.struct("event_id", "ts").alias("node"), "ts", "event_id")
    pairs = R.ranked_lookahead(e, "user_id", [F.col("ts"), F.col("event_id")], "node", 8)
    near = pairs.where(F.date_diff(F.col("target.ts").cast("date"), F.col("source.ts").cast("date")) <= 30)
    return near.select(F.col("source.event_id").alias("source"), F.col("target.event_id").alias("target"), F.col("steps").cast("int").alias("steps"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 20 = 0),
s AS (SELECT q.vec_id, e.vec_id AS other_id, list_cosine_similarity(q.v, e.v) AS c FROM q JOIN e ON q.vec_id <> e.vec_id)
SELECT vec_id, other_id, k AS place FROM (SELECT vec_id, other_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY round(c, 9) DESC, other_id) AS INTEGER) AS k FROM s) WHERE k <= 10""")
def jn17_nearest_vectors(s: SparkSession, d: str) -> DataFrame:
    """Exact: a stated query set against all vectors, in blocks of the matrix product."""
    from tidemark.operators.nearest import exact_nearest

    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    near = exact_nearest(e.where("id % 20 = 0"), e, 10)
    return near.select(F.col("id").alias("vec_id"), F.col("other").alias("other_id"), F.col("place"))


@query("""WITH a AS (SELECT anchor_rank, list_transform(vector, lambda x: CAST(x AS DOUBLE)) AS v FROM anchor_vector), e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
SELECT vec_id, anchor_rank FROM (SELECT vec_id, anchor_rank, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(e.v, a.v), 9) DESC, anchor_rank) AS k FROM e, a) WHERE k <= 8""")
def jn18_nearest_anchors(s: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.nearest import nearest_fixed

    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    a = table(s, d, "anchor_vector").select(F.col("anchor_rank").cast("long").alias("id"), "vector")
    return nearest_fixed(e, a, 8).select(F.col("id").alias("vec_id"), F.col("other").cast("int").alias("anchor_rank"))


@query("""WITH RECURSIVE s AS (SELECT DISTINCT id, parent_snapshot_id AS parent FROM event_map_snapshot), t AS (SELECT id AS root, id AS node, 0 AS depth FROM s WHERE parent IS NULL
UNION ALL SELECT t.root, s.id, t.depth + 1 FROM t JOIN s ON s.parent = t.node) SELECT * FROM t""")
def jn19_descendants(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "event_map_snapshot").select("id", F.col("parent_snapshot_id").alias("parent")).distinct()
    return R.closure(e, e.where("parent IS NULL"), "id", "parent")


@query("SELECT DISTINCT a.id, b.id AS parent, c.id AS grandparent FROM event_map_snapshot a LEFT JOIN event_map_snapshot b ON b.id = a.parent_snapshot_id LEFT JOIN event_map_snapshot c ON c.id = b.parent_snapshot_id")
def jn20_two_hops(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "event_map_snapshot").select("id", "parent_snapshot_id").distinct()
    up = lambda n: e.select(F.col("id").alias(n), F.col("parent_snapshot_id").alias(f"{n}_up"))
    j = e.join(up("parent"), F.col("parent_snapshot_id") == F.col("parent"), "left").join(up("grandparent"), F.col("parent_up") == F.col("grandparent"), "left")
    return j.select("id", "parent", "grandparent").distinct()


@query("""SELECT id FROM video WHERE id IN (SELECT video_id FROM asset WHERE type = 'video') UNION SELECT id FROM video WHERE id IN (SELECT source_video_id FROM event_record)
UNION SELECT id FROM video WHERE media_id IN (SELECT id FROM media WHERE time_zone IS NULL)""")
def jn21_union_of_relations(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "video").select("id", "media_id")
    scopes = [(table(s, d, "asset").where("type = 'video'").select(F.col("video_id").alias("id")), "id"), (table(s, d, "event_record").select(F.col("source_video_id").alias("id")), "id"), (table(s, d, "media").where("time_zone IS NULL").select(F.col("id").alias("media_id")), "media_id")]
    out = None
    for scope, key in scopes:
        part = R.within(v, scope, [key]).select("id")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


@query("""WITH m AS (SELECT DISTINCT snapshot_id, canonical_id, event_id FROM event_to_canonical WHERE canonical_id IS NOT NULL), g AS (SELECT snapshot_id, canonical_id, count(*) AS n FROM m GROUP BY ALL)
SELECT a.snapshot_id AS snapshot_a, a.canonical_id AS group_a, b.snapshot_id AS snapshot_b, b.canonical_id AS group_b, count(*) AS common, round(count(*) / (any_value(ga.n) + any_value(gb.n) - count(*)), 6) AS jaccard
FROM m a JOIN m b ON a.event_id = b.event_id AND (a.snapshot_id, a.canonical_id) < (b.snapshot_id, b.canonical_id) JOIN g ga ON ga.snapshot_id = a.snapshot_id AND ga.canonical_id = a.canonical_id JOIN g gb ON gb.snapshot_id = b.snapshot_id AND gb.canonical_id = b.canonical_id GROUP BY ALL""")
def jn22_membership_overlap(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "event_to_canonical").where("canonical_id IS NOT NULL").select("snapshot_id", "canonical_id", "event_id").distinct()
    g = m.groupBy("snapshot_id", "canonical_id").agg(F.count("*").alias("n"))
    m = m.join(g, ["snapshot_id", "canonical_id"]).withColumn("k", F.struct("snapshot_id", "canonical_id"))
    a, b = m.alias("a"), m.alias("b")
    j = a.join(b, (F.col("a.event_id") == F.col("b.event_id")) & (F.col("a.k") < F.col("b.k")))
    c = j.groupBy(F.col("a.k").alias("a"), F.col("b.k").alias("b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb")).agg(F.count("*").alias("common"))
    return c.select(F.col("a.snapshot_id").alias("snapshot_a"), F.col("a.canonical_id").alias("group_a"), F.col("b.snapshot_id").alias("snapshot_b"), F.col("b.canonical_id").alias("group_b"), "common", F.round(F.col("common") / (F.col("na") + F.col("nb") - F.col("common")), 6).alias("jaccard"))


@query("""WITH m AS (SELECT DISTINCT event_type, source_video_id FROM event_record WHERE event_type IS NOT NULL AND source_video_id IS NOT NULL), g AS (SELECT event_type, count(*) AS n FROM m GROUP BY 1)
SELECT a.event_type AS type_a, b.event_type AS type_b, count(*) AS common, round(count(*) / (any_value(ga.n) + any_value(gb.n) - count(*)), 6) AS jaccard
FROM m a JOIN m b ON a.source_video_id = b.source_video_id AND a.event_type < b.event_type JOIN g ga ON ga.event_type = a.event_type JOIN g gb ON gb.event_type = b.event_type GROUP BY ALL""")
def jn22_type_overlap(s: SparkSession, d: str) -> DataFrame:
    """The same over groups that share members on the test tables: types of events by the videos that report them."""
    m = table(s, d, "event_record").where("event_type IS NOT NULL AND source_video_id IS NOT NULL").select("event_type", "source_video_id").distinct()
    m = m.join(m.groupBy("event_type").agg(F.count("*").alias("n")), "event_type")
    a, b = m.alias("a"), m.alias("b")
    j = a.join(b, (F.col("a.source_video_id") == F.col("b.source_video_id")) & (F.col("a.event_type") < F.col("b.event_type")))
    c = j.groupBy(F.col("a.event_type").alias("type_a"), F.col("b.event_type").alias("type_b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb")).agg(F.count("*").alias("common"))
    return c.select("type_a", "type_b", "common", F.round(F.col("common") / (F.col("na") + F.col("nb") - F.col("common")), 6).alias("jaccard"))


@query("""WITH o AS (SELECT user_id AS k, ts, event_type FROM events), f AS (SELECT k, ts FROM o WHERE event_type = 'error')
SELECT k AS user_id, ts, CASE WHEN EXISTS (SELECT 1 FROM o WHERE o.k = f.k AND o.event_type = 'purchase' AND o.ts > f.ts) THEN 'recovered' WHEN EXISTS (SELECT 1 FROM o WHERE o.k = f.k AND o.event_type = 'signup') THEN 'active' ELSE 'retry' END AS label FROM f""")
def jn23_failed_then_recovered(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "events").select("user_id", "ts", "event_type")
    # The last success and any activity of a key decide; both are aggregates of the key.
    k = o.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("last"), F.bool_or(F.col("event_type") == "signup").alias("active"))
    f = o.where("event_type = 'error'").join(k, "user_id")
    label = F.when(F.col("last") > F.col("ts"), "recovered").when(F.col("active"), "active").otherwise("retry")
    return f.select("user_id", "ts", label.alias("label"))


@query("SELECT DISTINCT b.id, CAST(CASE WHEN v.id IS NOT NULL THEN json_object('id', v.id, 'title', v.title) END AS VARCHAR) AS frozen FROM brief_reference b LEFT JOIN (SELECT DISTINCT id, title FROM video) v ON v.id = b.object_id WHERE b.object_type = 'source'")
def jn24_freeze_quoted_objects(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "video").select(F.col("id").alias("object_id"), "title").distinct()
    v = v.withColumn("frozen", F.to_json(F.struct(F.col("object_id").alias("id"), "title"), {"ignoreNullFields": "false"}))
    return table(s, d, "brief_reference").where("object_type = 'source'").join(v, "object_id", "left").select("id", "frozen").distinct()


@query("SELECT media_id, id FROM (SELECT media_id, id, row_number() OVER (PARTITION BY media_id ORDER BY created_at, id) AS k FROM video WHERE status IN ('discovered', 'downloaded') AND media_id IS NOT NULL) WHERE k = 1")
def jn25_first_active(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "video").where("status IN ('discovered', 'downloaded') AND media_id IS NOT NULL")
    return R.first_per_key(v, ["media_id"], [F.col("created_at"), F.col("id")]).select("media_id", "id")


@query("SELECT DISTINCT a.id, coalesce(m.provider, CASE WHEN a.source = 'upload' THEN 'upload' END, 'unknown') AS provider FROM asset a LEFT JOIN (SELECT DISTINCT id, media_id FROM video) v ON v.id = a.video_id LEFT JOIN media m ON m.id = v.media_id")
def jn26_resolve_provider(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "video").select(F.col("id").alias("video_id"), "media_id").distinct()
    m = table(s, d, "media").select(F.col("id").alias("media_id"), "provider")
    j = table(s, d, "asset").join(v, "video_id", "left").join(m, "media_id", "left")
    return j.select("id", F.coalesce("provider", F.when(F.col("source") == "upload", F.lit("upload")), F.lit("unknown")).alias("provider")).distinct()
