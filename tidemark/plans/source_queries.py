"""Readers and encoders over whole tables, and the registry of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.registry import Catalog
from tidemark.sources import scene, subtitles
from tidemark.sources.tables import table

CATALOG = Catalog()
query = CATALOG.query
QUERIES, ORACLES = CATALOG.queries, CATALOG.oracles


def _cues(s: SparkSession, d: str, vtt: bool) -> DataFrame:
    """Titles of a domain's records as subtitle files, a file a video, with all titles of the video."""
    t = table(s, d, "event_record").where("source_video_id IS NOT NULL AND title IS NOT NULL").select("source_video_id", F.regexp_replace("title", r"[\r\n]+", " ").alias("title")).where("trim(title) <> ''").distinct()

    def stamp(n: Column) -> Column:
        h, m, sec = F.floor(n / 1800), F.floor(n % 1800 / 30), n % 30 * 2
        long = F.format_string("%02d:%02d:%02d" + (".500" if vtt else ",500"), h, m, sec)
        return F.when(h == 0, F.format_string("%02d:%02d.500", m, sec)).otherwise(long) if vtt else long

    titles = t.groupBy("source_video_id").agg(F.array_sort(F.collect_list("title")).alias("titles"))
    blocks = F.transform("titles", lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), stamp(i), F.lit(" --> "), stamp(i + 1), F.lit("\n"), x))
    return titles.select("source_video_id", F.concat(F.lit("WEBVTT\n\n" if vtt else ""), F.array_join(blocks, "\n\n")).alias("file"))


_TITLES = r"""WITH t AS (SELECT DISTINCT source_video_id, regexp_replace(title, '[\r\n]+', ' ', 'g') AS title FROM event_record WHERE source_video_id IS NOT NULL AND title IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY source_video_id ORDER BY title) - 1 AS i FROM t WHERE trim(title) <> '')"""


@query(_TITLES + " SELECT source_video_id, i * 2000 + 500 AS start_ms, (i + 1) * 2000 + 500 AS end_ms, trim(title) AS text FROM r")
def src07_srt_segments(s: SparkSession, d: str) -> DataFrame:
    return _cues(s, d, False).select("source_video_id", F.inline(subtitles.segments(F.col("file"))))


@query(_TITLES + " SELECT source_video_id, i * 2000 + 500 AS start_ms, (i + 1) * 2000 + 500 AS end_ms, trim(title) AS text FROM r")
def src08_vtt_segments(s: SparkSession, d: str) -> DataFrame:
    return _cues(s, d, True).select("source_video_id", F.inline(subtitles.segments(F.col("file"))))


@query(_TITLES + " SELECT source_video_id, string_agg(trim(title), chr(10) ORDER BY i) AS plain, count(*) AS cues FROM r GROUP BY 1")
def src09_normalized_subtitles(s: SparkSession, d: str) -> DataFrame:
    c = _cues(s, d, False).withColumn("seg", subtitles.segments(F.col("file")))
    return c.select("source_video_id", subtitles.plain_text(F.col("seg")).alias("plain"), F.size("seg").cast("long").alias("cues"))


@query("SELECT snapshot_id, count(DISTINCT canonical_id) AS n, count(DISTINCT canonical_id) * 56 AS bytes FROM event_map_canonical WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND event_start_day IS NOT NULL AND event_end_day IS NOT NULL GROUP BY 1")
def src15_scene_records(s: SparkSession, d: str) -> DataFrame:
    """Bytes of the encoded records of each snapshot."""
    from pyspark.sql import Window

    c = table(s, d, "event_map_canonical").dropna(subset=["x", "y", "z", "event_start_day", "event_end_day"]).dropDuplicates(["snapshot_id", "canonical_id"])
    w = Window.partitionBy("snapshot_id").orderBy("canonical_id")
    rows = c.select(
        (F.row_number().over(w) - 1).alias("point"), "canonical_id", "x", "y", "z", F.col("event_start_day").alias("start_day"), F.col("event_end_day").alias("end_day"), F.lit(0).alias("type_code"), F.lit(3).alias("precision_code"),
        F.col("has_uncertainty").alias("uncertain"), F.lit(False).alias("disagrees"), F.col("member_count").alias("members"), F.lit(None).cast("int").alias("macro"), F.lit(None).cast("int").alias("local"), "snapshot_id",
    )
    out = scene.encode(rows.drop("snapshot_id"))
    size = out.agg(F.avg(F.length("record"))).scalar()
    per = rows.groupBy("snapshot_id").agg(F.count("*").alias("n"))
    return per.select("snapshot_id", "n", (F.col("n") * size).cast("long").alias("bytes"))


@query("""WITH c AS (SELECT row_number() OVER (ORDER BY snapshot_id, canonical_id) - 1 AS p FROM (SELECT DISTINCT snapshot_id, canonical_id FROM event_map_canonical WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND event_start_day IS NOT NULL AND event_end_day IS NOT NULL))
SELECT p // 2048 AS chunk, CAST(min(p) AS INTEGER) AS first_point, count(*) AS n, count(*) * 56 AS bytes FROM c GROUP BY 1""")
def src06_scene_chunks(s: SparkSession, d: str) -> DataFrame:
    """All placed canonicals as one scene in chunks of 2,048 records, made where they lie."""
    c = table(s, d, "event_map_canonical").dropna(subset=["x", "y", "z", "event_start_day", "event_end_day"]).dropDuplicates(["snapshot_id", "canonical_id"])
    n = scene.numbered(c, ["snapshot_id", "canonical_id"])
    none = F.lit(None).cast("int")
    rows = n.select("point", "canonical_id", "x", "y", "z", F.col("event_start_day").alias("start_day"), F.col("event_end_day").alias("end_day"), F.lit(0).alias("type_code"), F.lit(3).alias("precision_code"), F.col("has_uncertainty").alias("uncertain"), F.lit(False).alias("disagrees"), F.col("member_count").alias("members"), none.alias("macro"), none.alias("local"))
    return scene.chunks(scene.encode(rows)).select("chunk", "first_point", "n", F.length("data").cast("long").alias("bytes"))


@query("SELECT status, count(*) AS n FROM event_map_snapshot WHERE status = 'ready' GROUP BY 1")
def src04_repeatable_read(s: SparkSession, d: str) -> DataFrame:
    """A reader of one version goes on seeing it after another has been published."""
    import uuid

    from tidemark.operators.publish import Publisher
    from tidemark.session import shared_dir

    pub, snap = Publisher(s, f"{shared_dir(s)}/versions-{uuid.uuid4().hex[:8]}"), table(s, d, "event_map_snapshot")
    first, _ = pub.publish("one", {"snapshots": snap.where("status = 'ready'")})
    pub.publish("two", {"snapshots": snap})
    return pub.read("snapshots", first).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT id, sha256(coalesce(name, '')) AS sha FROM media")
def src11_whole_objects(s: SparkSession, d: str) -> DataFrame:
    """Each name written as an object of its own, and the objects read back whole."""
    import uuid

    from tidemark.session import shared_dir
    from tidemark.sources.sinks import read_blobs

    path = f"{shared_dir(s)}/objects-{uuid.uuid4().hex[:8]}"
    m = table(s, d, "media").select("id", F.coalesce("name", F.lit("")).alias("name")).distinct()
    m.write.option("lineSep", "\u0001").partitionBy("id").text(path)
    name = F.url_decode(F.regexp_extract("path", r"/id=([^/]+)/", 1))
    return read_blobs(s, path, "*.txt").select(name.alias("id"), F.sha2(F.regexp_replace(F.decode("content", "UTF-8"), "\u0001$", ""), 256).alias("sha"))


@query("SELECT canonical_id, CAST(row_number() OVER (ORDER BY canonical_id) - 1 AS INTEGER) AS point FROM (SELECT DISTINCT canonical_id FROM event_map_canonical)")
def src17_contiguous_numbers(s: SparkSession, d: str) -> DataFrame:
    return scene.numbered(table(s, d, "event_map_canonical").select("canonical_id").distinct(), ["canonical_id"]).select("canonical_id", "point")


@query("SELECT 'media' AS name, count(*) AS rows FROM media UNION ALL SELECT 'video', count(*) FROM video UNION ALL SELECT 'asset', count(*) FROM asset")
def src21_table_copies(s: SparkSession, d: str) -> DataFrame:
    import uuid

    from tidemark.session import shared_dir
    from tidemark.sources.sinks import copy_tables

    return copy_tables(s, d, f"{shared_dir(s)}/copies-{uuid.uuid4().hex[:8]}", ["media", "video", "asset"])


@query("SELECT CAST(sum(n) AS BIGINT) AS archived FROM (SELECT count(*) AS n FROM event_map_snapshot)")
def src22_archive_manifest(s: SparkSession, d: str) -> DataFrame:
    import uuid

    from tidemark.session import shared_dir
    from tidemark.sources.sinks import archive

    m = archive(table(s, d, "event_map_snapshot"), f"{shared_dir(s)}/archive-{uuid.uuid4().hex[:8]}")
    return m.agg(F.sum("rows").alias("archived"))


@query(r"SELECT DISTINCT 'https://media.example/' || id AS url FROM media")
def src13_url_list_round_trip(s: SparkSession, d: str) -> DataFrame:
    import uuid

    from tidemark.session import shared_dir
    from tidemark.sources.sinks import read_urls, write_urls

    path = f"{shared_dir(s)}/urls-{uuid.uuid4().hex[:8]}"
    write_urls(table(s, d, "media").select(F.concat(F.lit("https://media.example/"), "id").alias("url")), "url", path)
    return read_urls(s, path)


@query("SELECT id, min(created_at) AS created_at FROM event_map_snapshot GROUP BY 1")
def src19_insert_ignore(s: SparkSession, d: str) -> DataFrame:
    """A table after two inserts of the same rows, of which the second changes nothing."""
    import uuid

    from tidemark.session import shared_dir
    from tidemark.sources.sinks import append_new

    path = f"{shared_dir(s)}/inserted-{uuid.uuid4().hex[:8]}"
    rows = table(s, d, "event_map_snapshot").groupBy("id").agg(F.min("created_at").alias("created_at"))
    for _ in range(2):
        append_new(rows, path, ["id"])
    return s.read.parquet(path)


@query("SELECT revision_id, min(event_id) AS event_id FROM event_record WHERE revision_id IS NOT NULL GROUP BY 1")
def src20_revision_sink(s: SparkSession, d: str) -> DataFrame:
    """Revisions appended in two halves by hash, each revision once."""
    import uuid

    from tidemark.session import shared_dir
    from tidemark.sources.sinks import append_new

    path = f"{shared_dir(s)}/revisions-{uuid.uuid4().hex[:8]}"
    r = table(s, d, "event_record").where("revision_id IS NOT NULL").groupBy("revision_id").agg(F.min("event_id").alias("event_id"))
    for half in (r.where(F.xxhash64("revision_id") % 2 == 0), r):
        append_new(half, path, ["revision_id"])
    return s.read.parquet(path)
