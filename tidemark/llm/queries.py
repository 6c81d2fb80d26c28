"""Queries of the operators for LLM data, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chunks, groups, mixing, similar, stuffing, tokens
from tidemark.sources.tables import norm_id, table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    match = table(spark, d, "event_match").where(F.lower(F.trim("decision")) == "merge")
    pairs = match.select(norm_id("event_id").alias("a"), norm_id("other_event_id").alias("b"))
    members = table(spark, d, "event_to_canonical").select(norm_id("event_id").alias("id"), norm_id("canonical_id").alias("hub"))
    keys = table(spark, d, "event_record").select(norm_id("event_id").alias("id"))
    return groups.groups(spark, pairs, members, keys).select(F.col("id").alias("event_id"), "group_id")


def p3_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many groups there are of each size."""
    size = p3_found(spark, d).groupBy("group_id").agg(F.count("*").alias("n_events"))
    return size.groupBy("n_events").agg(F.count("*").alias("n_groups"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    anchors = table(spark, d, "anchor_vector").select("anchor_rank", "vector")
    return similar.record_and_anchor_pairs(spark, table(spark, d, "event_record"), anchors, "vector_index", 64, 5, 0.9, 0.7)


def p5_similar(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar records of every record whose vector_index is divisible by 20, whatever the similarity."""
    return similar.ranked_similar(spark, table(spark, d, "event_record"), "vector_index", 64, 5, 20)


def _specs(spark: SparkSession, d: str) -> list[chunks.Spec]:
    # extraction_spec is a fixed table of a few rows.
    rows = table(spark, d, "extraction_spec").select("prompt_version", "chunk_max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("overlap_chars")).distinct()
    return [chunks.Spec(r[0], r[1], r[2]) for r in sorted(rows.where("prompt_version IS NOT NULL AND chunk_max_chars > 0").collect())]


def _pieces(spark: SparkSession, d: str, with_text: bool) -> DataFrame:
    video = table(spark, d, "video").select(norm_id("id").alias("video_id"), "description").where("video_id IS NOT NULL")
    specs = _specs(spark, d)
    # Rows that share an id are one video: its first text with one beyond the smallest limit, before anything is cut.
    long = video.where(F.length("description") > min((s.limit for s in specs), default=0))
    one = long.groupBy("video_id").agg(F.min("description").alias("description")) if with_text else long
    return chunks.pieces(one, "video_id", "description", specs, with_text)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d, False).select(F.col("spec").alias("prompt_version"), F.col("id").alias("video_id"), "forced").distinct()


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every piece with its bounds, the kind of cut that ends it, and its text."""
    flat = _pieces(spark, d, True).select(F.col("spec").alias("prompt_version"), F.col("id").alias("video_id"), F.inline("pieces"))
    return flat.select("prompt_version", "video_id", "piece_no", F.col("start").alias("start_char"), F.col("end").alias("end_char"), F.col("cut").alias("cut_kind"), F.col("text").alias("piece"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"), keep=["doc_id"])


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents drawn and how often each is used."""
    return mixing.mix(spark, table(spark, d, "documents"), table(spark, d, "mix_target"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of the tokens that each source reaches."""
    return mixing.mix(spark, table(spark, d, "documents"), table(spark, d, "mix_target"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed_pages(spark, table(spark, d, "documents")).select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p3_found, p3_sizes, p5_found, p5_similar, p7_found, p7_pieces, p8_ids, p9_mix, p9_shares, p10_found)}

_ID = "lower(trim({}, ' \t\r\n'))"
_GROUPS = f"""WITH RECURSIVE k AS (SELECT DISTINCT {_ID.format('event_id')} AS id FROM event_record),
m AS (SELECT {_ID.format('event_id')} AS a, {_ID.format('other_event_id')} AS b FROM event_match WHERE decision = 'merge'),
e AS (SELECT a, b FROM m WHERE a <> b AND a IN (FROM k) AND b IN (FROM k)
  UNION SELECT {_ID.format('event_id')}, '~' || {_ID.format('canonical_id')} FROM event_to_canonical WHERE canonical_id IS NOT NULL AND {_ID.format('event_id')} IN (FROM k)),
g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT DISTINCT a AS id, a AS reach FROM g UNION SELECT r.id, g.b FROM r JOIN g ON r.reach = g.a),
l AS (SELECT id, min(reach) AS group_id, count(*) FILTER (reach NOT LIKE '~%') AS n FROM r WHERE id NOT LIKE '~%' GROUP BY id),
f AS (SELECT id AS event_id, group_id FROM l WHERE n > 1)
"""
# The greedy rule as a recursion: from each cut the farthest boundary of the best kind in the later half of the reach,
# else the farthest in reach, else the limit itself.
_PIECES = f"""WITH RECURSIVE v AS (SELECT {_ID.format('id')} AS id, min(description) AS t FROM video WHERE length(description) > (SELECT min(chunk_max_chars) FROM extraction_spec) AND {_ID.format('id')} <> '' GROUP BY 1),
c AS (SELECT id, t, length(t) AS n, regexp_split_to_array(t, '') AS ch FROM v),
k AS (SELECT id, t, n, ch, list_transform(ch, lambda x: CASE WHEN x IN (chr(10), chr(11), chr(12), chr(13), chr(133), chr(8232), chr(8233)) THEN 3 WHEN x IN ('。', '！', '？') THEN 2 WHEN regexp_full_match(x, '[\\t-\\r\\x{{85}}\\p{{Z}}]') THEN 1 WHEN x IN ('.', '!', '?') THEN 1 ELSE 0 END) AS w FROM c),
m AS (SELECT id, t, n, ch, w, list_transform(range(1, n + 1), lambda i: ch[i] IN ('.', '!', '?', '。', '！', '？') AND (i = n OR regexp_full_match(ch[i + 1], '[\\t-\\r\\x{{85}}\\p{{Z}}]'))) AS stop FROM k),
b AS (SELECT id, t, n, list_transform(range(1, n + 1), lambda i: CASE WHEN stop[i] THEN 2 WHEN i > 1 AND stop[i - 1] AND w[i] = 1 THEN 2 ELSE w[i] END) AS kind FROM m),
l AS (SELECT s.prompt_version, b.id, b.t, b.n, CAST(s.chunk_max_chars AS BIGINT) AS lim, CAST(coalesce(s.overlap_chars, 0) AS BIGINT) AS ov, list_filter(range(1, b.n), lambda i: b.kind[i] = 3) AS lines, list_filter(range(1, b.n), lambda i: b.kind[i] >= 2) AS stops, list_filter(range(1, b.n), lambda i: b.kind[i] > 0) AS words
  FROM b JOIN (SELECT DISTINCT prompt_version, chunk_max_chars, overlap_chars FROM extraction_spec) s ON b.n > s.chunk_max_chars),
g AS (SELECT prompt_version, id, -1 AS piece_no, 0::BIGINT AS a, 0::BIGINT AS e, '' AS cut FROM l
  UNION ALL
  SELECT prompt_version, id, piece_no, a, coalesce(whole, line, stop, word, a + lim), CASE WHEN whole IS NOT NULL THEN 'end' WHEN line IS NOT NULL THEN 'line' WHEN stop IS NOT NULL THEN CASE WHEN list_contains(lines, stop) THEN 'line' ELSE 'sentence' END
    WHEN word IS NOT NULL THEN CASE WHEN list_contains(lines, word) THEN 'line' WHEN list_contains(stops, word) THEN 'sentence' ELSE 'word' END ELSE 'forced' END
  FROM (SELECT *, CASE WHEN a + lim >= n THEN n END AS whole, list_max(list_filter(lines, lambda x: x > greatest(a + lim // 2, p) AND x <= a + lim)) AS line,
      list_max(list_filter(stops, lambda x: x > greatest(a + lim // 2, p) AND x <= a + lim)) AS stop, list_max(list_filter(words, lambda x: x > p AND x <= a + lim)) AS word
    FROM (SELECT l.*, g.piece_no + 1 AS piece_no, g.e AS p, CASE WHEN g.e > 0 THEN g.e - l.ov ELSE 0 END AS a FROM g JOIN l ON l.prompt_version = g.prompt_version AND l.id = g.id WHERE g.e < l.n)))
SELECT g.prompt_version, g.id AS video_id, g.piece_no, CAST(g.a AS INTEGER) AS start_char, CAST(g.e AS INTEGER) AS end_char, g.cut AS cut_kind, array_to_string(list_slice(regexp_split_to_array(l.t, ''), g.a + 1, g.e), '') AS piece FROM g JOIN l ON l.prompt_version = g.prompt_version AND l.id = g.id WHERE g.piece_no >= 0"""
ORACLES: dict[str, str] = {
    "p3_found": _GROUPS + "SELECT * FROM f",
    "p3_sizes": _GROUPS + "SELECT n_events, count(*) AS n_groups FROM (SELECT group_id, count(*) AS n_events FROM f GROUP BY 1) GROUP BY 1",
    "p7_pieces": _PIECES,
    "p7_found": f"""SELECT DISTINCT s.prompt_version, {_ID.format('v.id')} AS video_id,
  CAST(list_max(list_transform(regexp_split_to_array(v.description, '[\\t-\\r\\x{{85}}\\p{{Z}}.!?。！？]'), lambda x: length(x))) > s.chunk_max_chars AS INTEGER) AS forced
FROM video v JOIN extraction_spec s ON length(v.description) > s.chunk_max_chars""",
}
