"""The snapshot pipeline and the read models on snapshots, over whole tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import canonical as K
from tidemark.operators import relational as R
from tidemark.operators import stories as S
from tidemark.operators.neighbours import neighbours as nearest_in_domain
from tidemark.operators.projection import type_codes
from tidemark.operators.publish import Publisher, fingerprints, input_key, staged_inputs
from tidemark.plans.registry import Catalog
from tidemark.plans.scalar_queries import FAMILY_SQL, PHASES_SQL, claim_terms_sql, conflict_sql, numbers_sql
from tidemark.session import Stages, shared_dir
from tidemark.sources.tables import norm_id, table

CATALOG = Catalog()
query = CATALOG.query
QUERIES, ORACLES = CATALOG.queries, CATALOG.oracles


def records(s: SparkSession, d: str) -> DataFrame:
    """Event records, an id once, with their domain."""
    r = table(s, d, "event_record").where("event_id IS NOT NULL").withColumn("domain", F.coalesce("playlist_id", F.lit("")))
    return R.first_per_key(r, ["event_id"], [F.col("created_at"), F.col("revision_id")])


def neighbours(s: SparkSession, d: str, r: DataFrame) -> DataFrame:
    """Candidate pairs within a domain, in both directions, as the match table lists them."""
    m = table(s, d, "event_match").select(norm_id("event_id").alias("a"), norm_id("other_event_id").alias("b"), "similarity").dropna()
    both = m.select(F.col("a").alias("left"), F.col("b").alias("right"), "similarity").unionByName(m.select(F.col("b").alias("left"), F.col("a").alias("right"), "similarity")).where("left <> right").distinct()
    own = r.select(F.col("event_id"), "domain")
    j = both.join(own.withColumnsRenamed({"event_id": "left", "domain": "ld"}), "left").join(own.withColumnsRenamed({"event_id": "right", "domain": "rd"}), "right")
    return j.where("ld = rd").select(F.col("ld").alias("domain"), "left", "right", "similarity")


@cache
def _rules() -> str:
    """Part of the build key: a change of the code that makes the tables makes new versions."""
    package = Path(__file__).resolve().parent.parent
    files = [Path(__file__).resolve(), *sorted(package.glob("operators/*.py")), *sorted(package.glob("functions/*.py"))]
    return hashlib.sha256(b"".join(f.read_bytes() for f in files)).hexdigest()


def _published(s: SparkSession, d: str, stage: str, make: Callable[[], dict[str, DataFrame]], inputs: tuple[str, ...] = ("event_record", "event_match")) -> Callable[[str], DataFrame]:
    """The tables of a stage of the build over a folder: made once, then read by every query over the same inputs."""
    pub = Publisher(s, f"{shared_dir(s)}/published/{stage}")
    key = input_key(s, [f"{d}/{t}.parquet" for t in inputs], {"stage": stage, "rules": _rules()})
    version = pub.find(key) or pub.publish(key, make())[0]
    return lambda name: pub.read(name, version)


def _prepared(s: SparkSession, d: str) -> DataFrame:
    """Records with what comparisons use."""
    return _published(s, d, "prepared", lambda: {"prepared": K.prepare(records(s, d))}, ("event_record",))("prepared")


def _canonical(s: SparkSession, d: str) -> Callable[[str], DataFrame]:
    """The tables members and groups."""

    def make() -> dict[str, DataFrame]:
        p = _prepared(s, d)
        members, groups = K.canonicalize(Stages(s, "canonical"), p, neighbours(s, d, p), p)
        return {"members": members, "groups": groups}

    return _published(s, d, "canonical", make)


def _nodes(s: SparkSession, d: str) -> Callable[[str], DataFrame]:
    """The table nodes: what the reports of each canonical event say together."""
    c = _canonical(s, d)
    return _published(s, d, "nodes", lambda: {"nodes": S.profiles(_prepared(s, d), c("members"), c("groups"))})


def _stories(s: SparkSession, d: str) -> Callable[[str], DataFrame]:
    """The tables scored, stories, members and edges."""
    n = _nodes(s, d)

    def make() -> dict[str, DataFrame]:
        st = Stages(s, "stories")
        scored = st.write(S.scored_edges(st, n("nodes")))
        stories, members, edges = S.build_stories(st, n("nodes"), scored)
        return {"scored": scored, "stories": stories, "members": members, "edges": edges}

    return _published(s, d, "stories", make)


_CONTENT = "concat_ws(chr(31), coalesce(title, ''), coalesce(summary, ''), coalesce(event_type, ''), coalesce(direction, ''), coalesce(start_day::VARCHAR, ''), coalesce(end_day::VARCHAR, ''), coalesce(time_precision, ''), coalesce(array_to_string(list_transform(entities, lambda e: concat_ws(chr(30), coalesce(e.entity_type, ''), coalesce(e.key, ''), coalesce(e.name, ''), coalesce(e.role, ''))), chr(29)), ''), coalesce(array_to_string(list_transform(relations, lambda r: concat_ws(chr(30), coalesce(r.relation_type, ''), coalesce(r.source_claim, ''), coalesce(r.target_claim, ''), coalesce(r.evidence_text, ''))), chr(29)), ''), coalesce(array_to_string(list_transform(evidence, lambda v: concat_ws(chr(30), coalesce(v.video_id, ''), coalesce(v.evidence_text, ''))), chr(29)), ''))"


_STAGED = f"""WITH r AS (SELECT * FROM (SELECT *, coalesce(playlist_id, '') AS domain, row_number() OVER (PARTITION BY event_id ORDER BY created_at, revision_id) AS k FROM event_record WHERE event_id IS NOT NULL) WHERE k = 1),
c AS (SELECT domain, event_id, sha256({_CONTENT}) AS content_hash, sha256(coalesce(array_to_string(list_transform(vector, lambda x: coalesce(CASE WHEN x < 1e9 AND x > -1e9 THEN CAST(floor(x::DOUBLE * 1000000)::BIGINT AS VARCHAR) END, '')), ','), '')) AS embedding_hash FROM r),
i AS (SELECT *, sha256(concat_ws('|', event_id, content_hash, embedding_hash)) AS input_hash, sha1(from_hex('6ba7b8129dad11d180b400c04fd430c8') || encode(domain || ':' || event_id || ':' || content_hash)) AS h FROM c)
"""


@query(_STAGED + "SELECT domain, count(*) AS records, sha256(string_agg(input_hash, ',' ORDER BY event_id)) AS fingerprint FROM i GROUP BY 1")
def dm01_input_fingerprints(s: SparkSession, d: str) -> DataFrame:
    """Per domain, what a build would freeze: the number of its records and a fingerprint of their inputs."""
    return fingerprints(staged_inputs(records(s, d)))


@query(f"""WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY created_at, revision_id) AS k FROM event_record WHERE event_id IS NOT NULL) WHERE k = 1)
SELECT event_id, sha256({_CONTENT}) AS content_hash FROM r""")
def dm01_revision_hashes(s: SparkSession, d: str) -> DataFrame:
    return staged_inputs(records(s, d)).select("event_id", "content_hash")


@query(_STAGED + "SELECT event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS revision_id, input_hash, embedding_hash FROM i")
def dm01_revision_ids(s: SparkSession, d: str) -> DataFrame:
    """Staged inputs with the id of the revision that their content names."""
    return staged_inputs(records(s, d)).select("event_id", "revision_id", "input_hash", "embedding_hash")


@query("""WITH t AS (SELECT DISTINCT coalesce(nullif(lower(trim(event_type)), ''), 'other') AS t FROM event_record), r AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS k, count(*) OVER () AS n FROM t)
SELECT t AS event_type, CAST(CASE WHEN n <= 255 THEN k WHEN t = 'other' OR k >= 254 THEN 254 ELSE k END AS INTEGER) AS type_code FROM r""")
def dm02_type_codes(s: SparkSession, d: str) -> DataFrame:
    return type_codes(table(s, d, "event_record"), "event_type")


def _prepared_sql() -> str:
    plain = "regexp_replace(lower(trim(coalesce({}, ''))), '[^0-9a-z㐀-鿿]+', '', 'g')".format
    alias = " ".join(f"WHEN '{a}' THEN '{k}'" for a, k in S.vocab.ENTITY_ALIASES.items())
    ignored = ", ".join(f"'{x}'" for x in S.vocab.IGNORED_ROLES)
    raw = f"coalesce(nullif({plain('e.key')}, ''), {plain('e.name')})"
    return f"""WITH r AS (SELECT * FROM (SELECT *, coalesce(playlist_id, '') AS domain, row_number() OVER (PARTITION BY event_id ORDER BY created_at, revision_id) AS k FROM event_record WHERE event_id IS NOT NULL) WHERE k = 1),
k AS (SELECT event_id, list_sort(list(DISTINCT coalesce(nullif({plain('e.entity_type')}, ''), 'other') || ':' || CASE {raw} {alias} ELSE {raw} END)) AS core FROM (SELECT event_id, unnest(entities) AS e FROM r) WHERE coalesce(e.role, '') NOT IN ({ignored}) AND {raw} <> '' GROUP BY 1),
p AS (SELECT domain, event_id, start_day, end_day, time_precision, coalesce(nullif({plain('event_type')}, ''), 'other') AS ty, {plain('direction')} AS dir, {plain('title')} AS ti, {plain('time_precision')} AS pr, coalesce(core, []) AS core, {numbers_sql("concat_ws(' ', title, summary)")} AS num FROM r LEFT JOIN k USING (event_id))
"""


_DECISION = f"""CASE WHEN a.start_day IS NULL OR b.start_day IS NULL OR a.end_day IS NULL OR b.end_day IS NULL OR greatest(a.start_day, b.start_day) > least(a.end_day, b.end_day) THEN 'time_disjoint'
WHEN coalesce(a.time_precision = 'year', false) OR coalesce(b.time_precision = 'year', false) THEN 'year_precision_exact_only'
WHEN NOT (a.ty = b.ty OR {' OR '.join(f"(a.ty IN {pair} AND b.ty IN {pair})" for pair in [f"('{x.replace('_', '')}', '{y.replace('_', '')}')" for x, y in S.vocab.COMPATIBLE_TYPES])}) THEN 'event_type_conflict'
WHEN a.dir NOT IN ({', '.join(f"'{x}'" for x in S.vocab.NEUTRAL_DIRECTIONS)}) AND b.dir NOT IN ({', '.join(f"'{x}'" for x in S.vocab.NEUTRAL_DIRECTIONS)}) AND a.dir <> b.dir THEN 'direction_conflict'
WHEN CASE WHEN len(a.core) = 0 OR len(b.core) = 0 THEN 0 ELSE len(list_intersect(a.core, b.core)) / len(list_distinct(a.core || b.core)) END < 0.5 THEN 'core_entity_overlap_below_0.5'
WHEN {conflict_sql('a.num', 'b.num')} THEN 'numeric_or_period_conflict'
WHEN m.w < CASE WHEN a.time_precision = 'month' OR b.time_precision = 'month' THEN 0.90 ELSE 0.85 END THEN 'cosine_too_low' ELSE 'allowed' END"""


@query(_prepared_sql() + "SELECT event_id, min(event_id) OVER x AS exact_group, count(*) OVER x AS exact_size FROM p WINDOW x AS (PARTITION BY domain, start_day, end_day, pr, ty, dir, core, ti, num)")
def dm03_exact_groups(s: SparkSession, d: str) -> DataFrame:
    return K.exact_groups(_prepared(s, d)).select("event_id", "exact_group", "exact_size")


@query(_prepared_sql() + f""", m AS (SELECT lower(trim(event_id)) AS a, lower(trim(other_event_id)) AS b, similarity AS w FROM event_match WHERE event_id IS NOT NULL AND other_event_id IS NOT NULL AND similarity IS NOT NULL),
n AS (SELECT a AS l, b AS o, w FROM m WHERE a <> b UNION SELECT b, a, w FROM m WHERE a <> b)
SELECT m.l AS left, m.o AS right, {_DECISION} AS decision FROM n m JOIN p a ON a.event_id = m.l JOIN p b ON b.event_id = m.o WHERE a.domain = b.domain""")
def dm04_fuzzy_pairs(s: SparkSession, d: str) -> DataFrame:
    p = _prepared(s, d)
    n = neighbours(s, d, p)
    p = p.select(*K.COMPARED)
    reason, need = K.refusal("a", "b")
    j = n.join(p.alias("a"), F.col("left") == F.col("a.event_id")).join(p.alias("b"), F.col("right") == F.col("b.event_id"))
    return j.select("left", "right", F.coalesce(reason, F.when(F.col("similarity") < need, "cosine_too_low"), F.lit("allowed")).alias("decision"))


def near_records(s: SparkSession, d: str, k: int = 32) -> DataFrame:
    """The most similar records of every record within its domain, as a build's projection joins them."""
    r = _prepared(s, d)
    return nearest_in_domain(r.select("domain", F.col("event_id").alias("id"), "vector"), k)


_NEAR = """v AS (SELECT domain, event_id, list_transform(vector, lambda x: x::DOUBLE) AS v FROM r WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
nn AS (SELECT a.domain, a.event_id AS l, b.event_id AS o, round(list_cosine_similarity(a.v, b.v), 9) AS w FROM v a JOIN v b ON a.domain = b.domain AND a.event_id <> b.event_id),
n AS (SELECT *, row_number() OVER (PARTITION BY domain, l ORDER BY w DESC, o) AS place FROM nn)"""


@query(_prepared_sql() + f", {_NEAR} SELECT domain, l AS event_id, o AS other_id, CAST(place AS INTEGER) AS place FROM n WHERE place <= 32")
def jn17_record_neighbours(s: SparkSession, d: str) -> DataFrame:
    """Every record's 32 nearest of its domain; exact where a domain is one cell, as all are up to sf0.1."""
    return near_records(s, d).select("domain", F.col("id").alias("event_id"), F.col("other").alias("other_id"), "place")


@query(_prepared_sql() + f", {_NEAR} SELECT m.l AS left, m.o AS right, {_DECISION} AS decision FROM n m JOIN p a ON a.event_id = m.l JOIN p b ON b.event_id = m.o WHERE m.place <= 32 AND m.w >= 0.8")
def dm04_neighbour_pairs(s: SparkSession, d: str) -> DataFrame:
    """The merge decisions of all neighbours of cosine 0.8 or more, those a build finds by itself."""
    p = _prepared(s, d).select(*K.COMPARED)
    reason, need = K.refusal("a", "b")
    n = near_records(s, d).where("similarity >= 0.8").select(F.col("id").alias("left"), F.col("other").alias("right"), "similarity")
    j = n.join(p.alias("a"), F.col("left") == F.col("a.event_id")).join(p.alias("b"), F.col("right") == F.col("b.event_id"))
    return j.select("left", "right", F.coalesce(reason, F.when(F.col("similarity") < need, "cosine_too_low"), F.lit("allowed")).alias("decision"))


@query("""WITH m AS (SELECT lower(trim(event_id)) AS a, lower(trim(other_event_id)) AS b, similarity AS w FROM event_match WHERE event_id IS NOT NULL AND other_event_id IS NOT NULL AND similarity IS NOT NULL AND lower(trim(event_id)) <> lower(trim(other_event_id))),
t AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY w DESC, b) AS k FROM (SELECT a, b, w FROM m UNION SELECT b, a, w FROM m)), o AS (SELECT a, max(b) FILTER (k = 1) AS b, max(w) FILTER (k = 1) AS w, max(w) FILTER (k = 2) AS w2 FROM t WHERE k <= 2 GROUP BY a),
s AS (SELECT * FROM o WHERE w2 IS NULL OR w - w2 >= 0.05) SELECT x.a AS left_id, x.b AS right_id FROM s x JOIN s y ON x.b = y.a AND y.b = x.a WHERE x.a < x.b""")
def dm05_mutual_best(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "event_match").select(norm_id("event_id").alias("a"), norm_id("other_event_id").alias("b"), F.col("similarity").alias("w")).dropna().where("a <> b")
    both = m.unionByName(m.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).distinct()
    top = R.first_per_key(both, ["a"], [F.desc("w"), F.col("b")], 2, "k")
    pick = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    o = top.groupBy("a").agg(pick(1, "b").alias("b"), pick(1, "w").alias("w"), pick(2, "w").alias("w2")).where("w2 IS NULL OR w - w2 >= 0.05")
    back = o.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return o.join(back, ["a", "b"]).where("a < b").select(F.col("a").alias("left_id"), F.col("b").alias("right_id"))


def _medoid_sql(name: str, source: str) -> str:
    """CTEs that end in ``name`` (g, rep): the medoid of each group of ``source`` (g, event_id, vector)."""
    return f"""{name}_u AS (SELECT g, event_id, vector, len(vector) AS d, sqrt(list_sum(list_transform(vector, lambda x: x::DOUBLE * x::DOUBLE))) AS nrm FROM {source} WHERE len(vector) > 0 AND len(list_filter(vector, lambda x: x IS NULL)) = 0),
{name}_v AS (SELECT g, event_id, d, list_transform(vector, lambda x: x::DOUBLE / nrm) AS u FROM {name}_u WHERE nrm > 0 AND nrm < 'inf'::DOUBLE),
{name}_d AS (SELECT g, arg_max(d, (n, d)) AS d FROM (SELECT g, d, count(*) AS n FROM {name}_v GROUP BY ALL) GROUP BY 1),
{name}_m AS (SELECT g, list(x ORDER BY i) AS c FROM (SELECT g, i, avg(x) AS x FROM (SELECT v.g, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM {name}_v v JOIN {name}_d USING (g, d)) GROUP BY ALL) GROUP BY 1),
{name} AS (SELECT v.g, arg_min(v.event_id, (-round(list_cosine_similarity(v.u, m.c), 8), v.event_id)) AS rep FROM {name}_v v JOIN {name}_d USING (g, d) JOIN {name}_m m USING (g) GROUP BY 1)"""


_COSINE = """CASE WHEN len(ra.vector) = len(rb.vector) THEN coalesce((SELECT CASE WHEN n > 0 AND n < 'inf'::DOUBLE THEN z / n END FROM (SELECT list_sum(list_transform(range(1, len(ra.vector) + 1), lambda i: ra.vector[i]::DOUBLE * rb.vector[i]::DOUBLE)) AS z,
  sqrt(list_sum(list_transform(ra.vector, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(rb.vector, lambda x: x::DOUBLE * x::DOUBLE))) AS n)), 0.0) ELSE 0.0 END"""
_CANONICAL = _prepared_sql().replace("WITH r AS", "WITH RECURSIVE r AS", 1).rstrip() + f""",
x AS (SELECT domain, event_id, min(event_id) OVER y AS exact_group, count(*) OVER y AS exact_size FROM p WINDOW y AS (PARTITION BY domain, start_day, end_day, pr, ty, dir, core, ti, num)),
m0 AS (SELECT lower(trim(event_id)) AS a, lower(trim(other_event_id)) AS b, similarity AS w FROM event_match WHERE event_id IS NOT NULL AND other_event_id IS NOT NULL AND similarity IS NOT NULL),
n0 AS (SELECT a AS l, b AS o, w FROM m0 WHERE a <> b UNION SELECT b, a, w FROM m0 WHERE a <> b),
j AS (SELECT a.domain, m.l, m.o, m.w, xa.exact_group AS lg, xb.exact_group AS rg FROM n0 m JOIN p a ON a.event_id = m.l JOIN p b ON b.event_id = m.o JOIN x xa ON xa.event_id = m.l JOIN x xb ON xb.event_id = m.o WHERE a.domain = b.domain AND xa.exact_group <> xb.exact_group AND {_DECISION} = 'allowed'),
t AS (SELECT *, row_number() OVER (PARTITION BY domain, l ORDER BY w DESC, o) AS k FROM j),
best AS (SELECT domain, l, max(o) FILTER (k = 1) AS target, max(w) FILTER (k = 1) AS best, max(w) FILTER (k = 2) AS runner_up, max(lg) FILTER (k = 1) AS og, max(rg) FILTER (k = 1) AS tg FROM t WHERE k <= 2 GROUP BY ALL),
sure AS (SELECT * FROM best WHERE runner_up IS NULL OR best - runner_up >= 0.05),
mu AS (SELECT s.domain, s.l, s.target, least(s.best, b.best) AS score, s.og, s.tg FROM sure s JOIN sure b ON b.domain = s.domain AND b.l = s.target AND b.target = s.l WHERE s.l < s.target),
xs AS (SELECT x.domain || chr(1) || x.exact_group AS g, r.event_id, r.vector FROM x JOIN r ON r.event_id = x.event_id WHERE x.exact_size > 1), {_medoid_sql('xm', 'xs')},
xr AS (SELECT DISTINCT x.domain, x.exact_group, x.exact_size AS size, coalesce(xm.rep, x.exact_group) AS rep FROM x LEFT JOIN xm ON xm.g = x.domain || chr(1) || x.exact_group),
pm AS (SELECT mu.*, a.rep AS ra_id, b.rep AS rb_id, a.size + b.size <= 100 AS fits, {_COSINE} AS w FROM mu JOIN xr a ON a.domain = mu.domain AND a.exact_group = mu.og JOIN xr b ON b.domain = mu.domain AND b.exact_group = mu.tg JOIN r ra ON ra.event_id = a.rep JOIN r rb ON rb.event_id = b.rep),
pairs AS (SELECT m.*, {_DECISION} = 'allowed' AS may, row_number() OVER (ORDER BY -m.score, m.l, m.target) AS turn FROM pm m JOIN p a ON a.event_id = m.ra_id JOIN p b ON b.event_id = m.rb_id),
q AS (SELECT *, row_number() OVER (ORDER BY turn) AS n FROM pairs WHERE fits AND may),
gr AS (SELECT 0::BIGINT AS n, CAST([] AS VARCHAR[]) AS used, false AS took UNION ALL SELECT q.n, CASE WHEN list_contains(used, q.domain || chr(1) || q.og) OR list_contains(used, q.domain || chr(1) || q.tg) THEN used ELSE used || [q.domain || chr(1) || q.og, q.domain || chr(1) || q.tg] END,
  NOT (list_contains(used, q.domain || chr(1) || q.og) OR list_contains(used, q.domain || chr(1) || q.tg)) FROM gr JOIN q ON q.n = gr.n + 1),
merged AS (SELECT q.* FROM q JOIN gr ON gr.n = q.n WHERE gr.took),
inn AS (SELECT domain, tg AS exact_group, og AS group_id, turn, score FROM merged UNION ALL SELECT domain, og, og, turn, score FROM merged),
late AS (SELECT p2.*, coalesce(i.group_id = k.group_id, false) AS together, coalesce(i.turn < p2.turn, false) OR coalesce(k.turn < p2.turn, false) AS crowded FROM pairs p2 LEFT JOIN inn i ON i.domain = p2.domain AND i.exact_group = p2.og LEFT JOIN inn k ON k.domain = p2.domain AND k.exact_group = p2.tg),
fl AS (SELECT domain, l AS event_id, 'ambiguous_fuzzy_candidates' AS flag FROM best WHERE runner_up IS NOT NULL AND best - runner_up < 0.05
  UNION ALL SELECT domain, unnest([l, target]), 'ambiguous_fuzzy_candidates' FROM late WHERE NOT together AND crowded UNION ALL SELECT domain, unnest([l, target]), 'fuzzy_cluster_size_limit' FROM late WHERE NOT together AND NOT crowded AND NOT fits),
mem AS (SELECT x.domain, x.event_id, coalesce(i.group_id, x.exact_group) AS group_id, CASE WHEN x.exact_size > 1 THEN 'exact' WHEN i.score IS NOT NULL THEN 'fuzzy' ELSE 'singleton' END AS rule, CASE WHEN x.exact_size > 1 THEN 1.0 ELSE i.score END AS score, b.runner_up
  FROM x LEFT JOIN inn i ON i.domain = x.domain AND i.exact_group = x.exact_group LEFT JOIN best b ON b.domain = x.domain AND b.l = x.event_id),
sz AS (SELECT domain, group_id, count(*) AS size, min(event_id) AS lone FROM mem GROUP BY ALL),
ms AS (SELECT mem.domain || chr(1) || mem.group_id AS g, r.event_id, r.vector FROM mem JOIN sz USING (domain, group_id) JOIN r ON r.event_id = mem.event_id WHERE sz.size > 1), {_medoid_sql('mm', 'ms')},
ff AS (SELECT mem.domain, mem.group_id, list_sort(list(DISTINCT flag)) AS flags FROM fl JOIN mem USING (domain, event_id) GROUP BY ALL)
"""


@query(_CANONICAL + "SELECT sz.domain, sz.group_id, coalesce(mm.rep, sz.lone) AS representative, sz.size, coalesce(ff.flags, []) AS flags FROM sz LEFT JOIN mm ON mm.g = sz.domain || chr(1) || sz.group_id LEFT JOIN ff ON ff.domain = sz.domain AND ff.group_id = sz.group_id")
def dm06_canonical_groups(s: SparkSession, d: str) -> DataFrame:
    return _canonical(s, d)("groups")


@query(_CANONICAL + "SELECT domain, event_id, group_id, rule, score, runner_up FROM mem")
def dm06_canonical_members(s: SparkSession, d: str) -> DataFrame:
    return _canonical(s, d)("members")


_LINEAGE = _CANONICAL + """, pv AS (SELECT event_id, min(canonical_id) AS canonical_id FROM event_to_canonical WHERE canonical_id IS NOT NULL GROUP BY 1),
po AS (SELECT r.domain, pv.event_id, pv.canonical_id FROM pv JOIN r USING (event_id)), was AS (SELECT domain, canonical_id, count(*) AS was FROM po GROUP BY ALL),
cm AS (SELECT mem.domain, group_id, canonical_id, count(*) AS common FROM mem JOIN po USING (domain, event_id) GROUP BY ALL),
cc AS (SELECT cm.*, count(*) OVER (PARTITION BY cm.domain, cm.group_id) AS preds, count(*) OVER (PARTITION BY cm.domain, cm.canonical_id) AS succs, sz.size, was.was FROM cm JOIN sz USING (domain, group_id) JOIN was USING (domain, canonical_id)),
kp AS (SELECT *, preds = 1 AND succs = 1 AND common / size >= 0.5 AND common / was >= 0.5 AS keeps FROM cc),
hk AS (SELECT domain, group_id, sha256(string_agg(event_id, ',' ORDER BY event_id)) AS k FROM mem GROUP BY domain, group_id),
hs AS (SELECT domain, group_id, sha1(from_hex('6ba7b8129dad11d180b400c04fd430c8') || encode(domain || ':build:' || k)) AS h FROM hk),
ids AS (SELECT hs.domain, hs.group_id, k.canonical_id AS kept, coalesce(k.canonical_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)) AS canonical_id FROM hs LEFT JOIN (SELECT * FROM kp WHERE keeps) k USING (domain, group_id))
"""


def _identities(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r, members = _prepared(s, d), _canonical(s, d)("members")
    prior = table(s, d, "event_to_canonical").where("canonical_id IS NOT NULL").select("event_id", "canonical_id").distinct()
    prior = R.first_per_key(prior, ["event_id"], [F.col("canonical_id")]).join(r.select("event_id", "domain"), "event_id")
    sizes = prior.groupBy("domain", "canonical_id").agg(F.count("*").alias("size"))
    return K.identities(members, prior, sizes, "build")


@query(_LINEAGE + "SELECT domain, group_id, canonical_id, CASE WHEN kept IS NULL THEN 'new' ELSE 'retained' END AS state FROM ids")
def dm07_identities(s: SparkSession, d: str) -> DataFrame:
    return _identities(s, d)[0]


@query(_LINEAGE + "SELECT kp.domain, kp.canonical_id AS predecessor, ids.canonical_id AS successor, CASE WHEN preds > 1 THEN 'merge' WHEN succs > 1 THEN 'split' ELSE 'replaced' END AS relation_type, round(common / size, 6) AS confidence FROM kp JOIN ids USING (domain, group_id) WHERE NOT keeps AND ids.kept IS NULL")
def dm08_lineage(s: SparkSession, d: str) -> DataFrame:
    return _identities(s, d)[1].withColumn("confidence", F.round("confidence", 6))


@query(_CANONICAL + f""", tx AS (SELECT event_id, lower(concat_ws(' ', title, summary)) AS t, list_transform(entities, lambda e: e.name) AS names FROM r), {claim_terms_sql('tx', 'te')},
ph AS (SELECT event_id, list_filter([{PHASES_SQL}], lambda p: p IS NOT NULL) AS phases FROM (SELECT event_id, t AS x FROM tx)),
so AS (SELECT event_id, list_filter([source_video_id] || coalesce(list_transform(evidence, lambda v: v.video_id), []), lambda v: v IS NOT NULL) AS sources FROM r),
un AS (SELECT mem.domain, mem.group_id, min(r.start_day) AS start_day, max(r.end_day) AS end_day, list_distinct(flatten(list(te.terms))) AS terms, list_distinct(flatten(list(so.sources))) AS sources, list_sort(list_distinct(flatten(list(ph.phases)))) AS phases FROM mem JOIN r ON r.event_id = mem.event_id JOIN te ON te.event_id = mem.event_id JOIN so ON so.event_id = mem.event_id JOIN ph ON ph.event_id = mem.event_id GROUP BY ALL),
hd AS (SELECT sz.domain, sz.group_id, coalesce(mm.rep, sz.lone) AS node FROM sz LEFT JOIN mm ON mm.g = sz.domain || chr(1) || sz.group_id)
SELECT un.domain, hd.node, un.start_day, un.end_day, CAST(len(terms) AS INTEGER) AS n_terms, CAST(len(sources) AS INTEGER) AS n_sources, phases, (SELECT CASE {FAMILY_SQL} ELSE 'other' END FROM (SELECT trim(regexp_replace(lower(trim(coalesce(r.event_type, ''))), '[^0-9a-z]+', '_', 'g'), '_') AS t)) AS family
FROM un JOIN hd USING (domain, group_id) JOIN r ON r.event_id = hd.node""")
def dm09_story_profiles(s: SparkSession, d: str) -> DataFrame:
    n = _nodes(s, d)("nodes")
    return n.select("domain", "node", "start_day", "end_day", F.size("terms").alias("n_terms"), F.size("sources").alias("n_sources"), "phases", "family")


@query()
def dm10_story_edges(s: SparkSession, d: str) -> DataFrame:
    return _stories(s, d)("scored").select("domain", "source", "target", "anchor_key", "relation_type", "confidence", "gap_days")


@query(f"""WITH k AS (SELECT DISTINCT event_id, e.key AS key, e.entity_type AS t FROM (SELECT event_id, unnest(entities) AS e FROM event_record) WHERE e.key IS NOT NULL)
SELECT event_id, arg_min(key, (CASE t {' '.join(f"WHEN '{t}' THEN {-p}" for t, p in S.vocab.ENTITY_PRIORITY.items())} ELSE 0 END, key)) AS anchor FROM k GROUP BY 1""")
def dm11_anchor_choice(s: SparkSession, d: str) -> DataFrame:
    k = table(s, d, "event_record").select("event_id", F.explode("entities").alias("e")).select("event_id", "e.key", "e.entity_type").where("key IS NOT NULL").distinct()
    p = F.coalesce(S.X.lookup(S.vocab.ENTITY_PRIORITY, F.col("entity_type")), F.lit(0))
    return k.groupBy("event_id").agg(F.min_by("key", F.struct((-p).alias("p"), "key")).alias("anchor"))


@query()
def dm12_story_members(s: SparkSession, d: str) -> DataFrame:
    return _stories(s, d)("members")


@query()
def dm13_stories(s: SparkSession, d: str) -> DataFrame:
    return _stories(s, d)("stories")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT s.playlist_id, s.parent_snapshot_id AS parent, c.snapshot_id || '/' || c.canonical_id AS story, c.event_id FROM event_to_canonical c JOIN event_map_snapshot s ON s.id = c.snapshot_id WHERE c.canonical_id IS NOT NULL),
n AS (SELECT DISTINCT playlist_id, story, event_id FROM e WHERE parent IS NOT NULL), o AS (SELECT DISTINCT playlist_id, story AS identity, event_id FROM e WHERE parent IS NULL),
cm AS (SELECT n.playlist_id, n.story, o.identity, count(*) AS common FROM n JOIN o ON o.playlist_id = n.playlist_id AND o.event_id = n.event_id GROUP BY ALL),
ns AS (SELECT playlist_id, story, count(DISTINCT event_id) AS n FROM n GROUP BY ALL), os AS (SELECT playlist_id, identity, count(DISTINCT event_id) AS was FROM o GROUP BY ALL),
sc AS (SELECT *, greatest(common / (n + was - common), common / least(n, was)) AS score FROM cm JOIN ns USING (playlist_id, story) JOIN os USING (playlist_id, identity)),
k AS (SELECT story, identity, row_number() OVER (ORDER BY -score, -common, identity, story) AS n FROM sc WHERE score >= 0.5),
g AS (SELECT 0::BIGINT AS n, CAST([] AS VARCHAR[]) AS used, false AS took UNION ALL SELECT k.n, CASE WHEN list_contains(used, 's' || story) OR list_contains(used, 'i' || identity) THEN used ELSE used || ['s' || story, 'i' || identity] END, NOT (list_contains(used, 's' || story) OR list_contains(used, 'i' || identity)) FROM g JOIN k ON k.n = g.n + 1),
t AS (SELECT k.story, k.identity FROM k JOIN g ON g.n = k.n WHERE g.took)
SELECT s.story, coalesce(t.identity, s.story) AS identity, CASE WHEN t.identity IS NULL THEN 'new' ELSE 'retained' END AS state FROM (SELECT DISTINCT story FROM n) s LEFT JOIN t USING (story)""")
def dm14_story_identities(s: SparkSession, d: str) -> DataFrame:
    """Groups of a snapshot as stories of their domain against those of the parent snapshot."""
    st = Stages(s, "story-identities")
    e = table(s, d, "event_to_canonical").dropna(subset=["canonical_id"]).join(table(s, d, "event_map_snapshot").select(F.col("id").alias("snapshot_id"), "playlist_id", "parent_snapshot_id").distinct(), "snapshot_id")
    now = e.where("parent_snapshot_id IS NOT NULL").select(F.col("playlist_id").alias("anchor_key"), F.concat_ws("/", "snapshot_id", "canonical_id").alias("story"), F.col("event_id").alias("canonical_id")).distinct()
    old = e.where("parent_snapshot_id IS NULL").select(F.col("playlist_id").alias("anchor_key"), F.concat_ws("/", "snapshot_id", "canonical_id").alias("story"), F.col("event_id").alias("canonical_id")).distinct()
    return S.story_identities(st, now, old)


@query("""WITH p AS (SELECT DISTINCT s.id, s.parent_snapshot_id AS parent FROM event_map_snapshot s WHERE s.parent_snapshot_id IS NOT NULL), g AS (SELECT snapshot_id, event_type, list_sort(list(DISTINCT canonical_id)) AS m FROM event_map_canonical GROUP BY ALL)
SELECT p.id AS snapshot_id, n.event_type, o.m IS NULL OR n.m <> o.m AS material FROM p JOIN g n ON n.snapshot_id = p.id LEFT JOIN g o ON o.snapshot_id = p.parent AND o.event_type IS NOT DISTINCT FROM n.event_type""")
def dm15_material_change(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "event_map_canonical").groupBy("snapshot_id", "event_type").agg(F.array_sort(F.collect_set("canonical_id")).alias("m"))
    none = F.array().cast("array<struct<source:string,target:string,relation_type:string,direction:string,status:string,revisions:array<string>,claims:array<string>>>")
    f = g.select("snapshot_id", "event_type", S.material_form(F.col("m"), F.lit(""), none).alias("f"))
    p = table(s, d, "event_map_snapshot").where("parent_snapshot_id IS NOT NULL").select(F.col("id").alias("snapshot_id"), F.col("parent_snapshot_id").alias("parent")).distinct()
    n = f.join(p, "snapshot_id")
    o = f.select(F.col("snapshot_id").alias("parent"), F.col("event_type").alias("t"), F.col("f").alias("was"))
    j = n.join(o, (n["parent"] == o["parent"]) & n["event_type"].eqNullSafe(o["t"]), "left")
    return j.select("snapshot_id", "event_type", (~F.col("f").eqNullSafe(F.col("was"))).alias("material"))


@query("""WITH p AS (SELECT DISTINCT id, parent_snapshot_id AS parent, created_at FROM event_map_snapshot WHERE status = 'ready' AND parent_snapshot_id IN (SELECT id FROM event_map_snapshot)), c AS (SELECT DISTINCT snapshot_id, canonical_id, revision_id, member_count FROM event_map_canonical),
n AS (SELECT p.id, p.created_at, c.canonical_id, bool_and(EXISTS (SELECT 1 FROM c o WHERE o.snapshot_id = p.parent AND o.canonical_id = c.canonical_id AND o.revision_id IS NOT DISTINCT FROM c.revision_id AND o.member_count IS NOT DISTINCT FROM c.member_count)) AS same FROM p JOIN c ON c.snapshot_id = p.id GROUP BY ALL)
SELECT id AS snapshot_id, canonical_id, 'active' AS status, created_at AS updated_at FROM n WHERE NOT same
UNION ALL SELECT DISTINCT p.id, c.canonical_id, 'retired', p.created_at FROM p JOIN c ON c.snapshot_id = p.parent WHERE NOT EXISTS (SELECT 1 FROM c n WHERE n.snapshot_id = p.id AND n.canonical_id = c.canonical_id)""")
def dm16_identity_status(s: SparkSession, d: str) -> DataFrame:
    """Identities that a ready snapshot makes or changes become active, those that its parent had and it has not retire."""
    snap = table(s, d, "event_map_snapshot")
    p = snap.where("status = 'ready'").select(F.col("id").alias("domain"), F.col("parent_snapshot_id").alias("parent"), F.col("created_at").alias("updated_at")).distinct().join(snap.select(F.col("id").alias("parent")).distinct(), "parent", "left_semi")
    c = table(s, d, "event_map_canonical").select("snapshot_id", "canonical_id", "revision_id", "member_count").distinct()
    now, old = (p.join(c, F.col("snapshot_id") == F.col(side)).select("domain", "canonical_id", "revision_id", "member_count") for side in ("domain", "parent"))
    form = F.struct("revision_id", "member_count")
    was = old.select("domain", "canonical_id", F.to_json(form, {"ignoreNullFields": "false"}).alias("form"))
    changed = now.withColumn("form", F.to_json(form, {"ignoreNullFields": "false"})).join(was, ["domain", "canonical_id", "form"], "left_anti")
    out = K.identity_status(now, old, changed).join(p.select("domain", "updated_at"), "domain")
    return out.withColumnRenamed("domain", "snapshot_id").select("snapshot_id", "canonical_id", "status", "updated_at")


@query("SELECT id, input_generation, row_number() OVER (PARTITION BY playlist_id, input_generation ORDER BY status = 'ready' DESC, created_at, id) > 1 AS reused FROM (SELECT DISTINCT id, playlist_id, input_generation, status, created_at FROM event_map_snapshot)")
def dm17_reuse_by_build_key(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "event_map_snapshot").select("id", "playlist_id", "input_generation", "status", "created_at").distinct()
    w = Window.partitionBy("playlist_id", "input_generation").orderBy(F.expr("status = 'ready'").desc(), "created_at", "id")
    return x.select("id", "input_generation", (F.row_number().over(w) > 1).alias("reused"))


@query("""WITH c AS (SELECT DISTINCT snapshot_id, canonical_id, revision_id FROM event_map_canonical), p AS (SELECT DISTINCT id, parent_snapshot_id AS parent FROM event_map_snapshot WHERE parent_snapshot_id IN (SELECT id FROM event_map_snapshot)),
x AS (SELECT p.id, (SELECT count(*) FROM c WHERE c.snapshot_id = p.parent) AS total, (SELECT count(*) FROM c WHERE c.snapshot_id = p.id AND NOT EXISTS (SELECT 1 FROM c o WHERE o.snapshot_id = p.parent AND o.canonical_id = c.canonical_id AND o.revision_id IS NOT DISTINCT FROM c.revision_id)) AS changed FROM p)
SELECT id AS snapshot_id, changed, changed <= greatest(10, CAST(floor(total * 0.02) AS BIGINT)) AS anchored FROM x""")
def dm18_layout_decision(s: SparkSession, d: str, least: int = 10) -> DataFrame:
    c = table(s, d, "event_map_canonical").select("snapshot_id", "canonical_id", "revision_id").distinct()
    snap = table(s, d, "event_map_snapshot").select("id", F.col("parent_snapshot_id").alias("parent")).distinct()
    p = snap.join(snap.select(F.col("id").alias("parent")).distinct(), "parent", "left_semi")
    total = c.groupBy(F.col("snapshot_id").alias("parent")).agg(F.count("*").alias("total"))
    old = c.select(F.col("snapshot_id").alias("parent"), "canonical_id", F.coalesce("revision_id", F.lit("")).alias("r"))
    new = p.join(c, F.col("snapshot_id") == F.col("id")).withColumn("r", F.coalesce("revision_id", F.lit("")))
    changed = new.join(old, ["parent", "canonical_id", "r"], "left_anti").groupBy("id").agg(F.count("*").alias("changed"))
    j = p.join(total, "parent", "left").join(changed, "id", "left").fillna(0, ["total", "changed"])
    return j.select(F.col("id").alias("snapshot_id"), "changed", (F.col("changed") <= F.greatest(F.lit(least), F.floor(F.col("total") * 0.02))).alias("anchored"))


_CURRENT = "SELECT playlist_id, arg_max(id, (created_at, id)) AS id FROM event_map_snapshot WHERE status = 'ready' GROUP BY 1"


def current(s: SparkSession, d: str) -> DataFrame:
    """The newest ready snapshot of each domain."""
    x = table(s, d, "event_map_snapshot").where("status = 'ready'")
    return x.groupBy("playlist_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("snapshot_id"))


def _current_rows(s: SparkSession, d: str, *columns: str) -> DataFrame:
    c = table(s, d, "event_map_canonical").select("snapshot_id", *columns).distinct()
    return c.join(current(s, d), "snapshot_id")


@query(f"""WITH k AS ({_CURRENT}), c AS (SELECT DISTINCT k.playlist_id, canonical_id, event_start_day, has_uncertainty FROM event_map_canonical c JOIN k ON k.id = c.snapshot_id)
SELECT 'newly_occurred' AS feed, playlist_id, canonical_id FROM (SELECT *, row_number() OVER (PARTITION BY playlist_id ORDER BY event_start_day DESC, canonical_id) AS r FROM c WHERE event_start_day > 20400) WHERE r <= 30
UNION ALL SELECT 'needs_review', playlist_id, canonical_id FROM (SELECT *, row_number() OVER (PARTITION BY playlist_id ORDER BY event_start_day DESC NULLS LAST, canonical_id) AS r FROM c WHERE has_uncertainty) WHERE r <= 30""")
def dm19_observation_feed(s: SparkSession, d: str, cursor_day: int = 20400) -> DataFrame:
    c = _current_rows(s, d, "canonical_id", "event_start_day", "has_uncertainty")
    order = [F.desc_nulls_last("event_start_day"), F.col("canonical_id")]
    top = lambda df: R.first_per_key(df, ["playlist_id"], order, 30).select("playlist_id", "canonical_id")
    return R.tagged_union({"newly_occurred": top(c.where(F.col("event_start_day") > cursor_day)), "needs_review": top(c.where("has_uncertainty"))}, "feed")


@query(f"""WITH k AS ({_CURRENT}), m AS (SELECT DISTINCT k.playlist_id, e.canonical_id, r.event_id, r.source_video_id, r.start_day FROM event_to_canonical e JOIN k ON k.id = e.snapshot_id JOIN event_record r ON r.event_id = e.event_id WHERE e.canonical_id IS NOT NULL AND r.time_precision IN ('day', 'second')),
g AS (SELECT playlist_id, canonical_id, count(DISTINCT source_video_id) AS sources, max(start_day) AS day FROM m GROUP BY ALL) SELECT playlist_id, canonical_id, sources FROM (SELECT *, row_number() OVER (PARTITION BY playlist_id ORDER BY sources DESC, day DESC NULLS LAST, canonical_id) AS r FROM g) WHERE r <= 10""")
def dm20_event_highlights(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "event_record").where("time_precision IN ('day', 'second')").select("event_id", "source_video_id", "start_day")
    e = table(s, d, "event_to_canonical").where("canonical_id IS NOT NULL").join(current(s, d), "snapshot_id").select("playlist_id", "canonical_id", "event_id")
    g = e.join(r, "event_id").distinct().groupBy("playlist_id", "canonical_id").agg(F.countDistinct("source_video_id").alias("sources"), F.max("start_day").alias("day"))
    return R.first_per_key(g, ["playlist_id"], [F.desc("sources"), F.desc_nulls_last("day"), F.col("canonical_id")], 10).select("playlist_id", "canonical_id", "sources")


@query(f"""WITH k AS ({_CURRENT}) SELECT k.playlist_id, k.id AS snapshot_id, (SELECT count(DISTINCT canonical_id) FROM event_map_canonical c WHERE c.snapshot_id = k.id) AS canonicals, (SELECT count(DISTINCT event_id) FROM event_record r WHERE r.playlist_id = k.playlist_id) AS records FROM k""")
def dm21_domain_directory(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "event_map_canonical").groupBy("snapshot_id").agg(F.countDistinct("canonical_id").alias("canonicals"))
    r = table(s, d, "event_record").groupBy("playlist_id").agg(F.countDistinct("event_id").alias("records"))
    j = current(s, d).join(c, "snapshot_id", "left").join(r, "playlist_id", "left")
    return j.select("playlist_id", "snapshot_id", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("canonicals", "records")])


@query(f"""WITH k AS ({_CURRENT}) SELECT DISTINCT c.canonical_id, c.title, c.event_start_day, c.member_count FROM event_map_canonical c JOIN k ON k.id = c.snapshot_id WHERE c.event_end_day >= 20200 AND c.event_start_day <= 20500 ORDER BY c.event_start_day DESC, c.canonical_id LIMIT 100""")
def dm22_canonical_directory(s: SparkSession, d: str) -> DataFrame:
    c = _current_rows(s, d, "canonical_id", "title", "event_start_day", "event_end_day", "member_count").where(R.overlaps(F.col("event_start_day"), F.col("event_end_day"), 20200, 20500))
    return c.select("canonical_id", "title", "event_start_day", "member_count").distinct().orderBy(F.desc("event_start_day"), "canonical_id").limit(100)


@query(f"""WITH k AS ({_CURRENT}), c AS (SELECT DISTINCT k.playlist_id, c.event_type, c.canonical_id, c.member_count FROM event_map_canonical c JOIN k ON k.id = c.snapshot_id)
SELECT playlist_id, event_type, canonical_id FROM (SELECT *, row_number() OVER (PARTITION BY playlist_id, event_type ORDER BY member_count DESC NULLS LAST, canonical_id) AS r FROM c) WHERE r <= 20""")
def dm23_topic_detail(s: SparkSession, d: str) -> DataFrame:
    c = _current_rows(s, d, "event_type", "canonical_id", "member_count")
    return R.first_per_key(c, ["playlist_id", "event_type"], [F.desc_nulls_last("member_count"), F.col("canonical_id")], 20).select("playlist_id", "event_type", "canonical_id")


@query()
def dm24_story_directory(s: SparkSession, d: str) -> DataFrame:
    c = _stories(s, d)
    stories, members = c("stories"), c("members")
    last = members.groupBy("story_id").agg(F.max_by("node", "position").alias("last_node"))
    return stories.join(last, "story_id").select("domain", "story_id", "label", "maturity", "n_members", "last_node")


def event_nodes(s: SparkSession, d: str) -> DataFrame:
    """Story nodes of the events table: a user's week is an entity, an event's type its phase and cue, and its property
    the terms, numbers, vector and doubt that edges rest on. Its stories are not empty, unlike those of the records."""
    e = table(s, d, "events").select("event_id", "user_id", "event_type", F.unix_date(F.col("ts").cast("date")).alias("day"), F.get_json_object("props", "$.k").try_cast("long").alias("k"))
    text = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in c])
    phase = S.X.lookup(EVENT_PHASES, F.col("event_type"))
    said = F.coalesce(S.X.lookup({"error": "correction issued", "signup": "response given"}, F.col("event_type")), F.lit(""))
    k, u, n = F.col("k"), F.col("user_id"), F.col("event_id")
    vector = F.when(k % 2 == 0, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.9), F.sqrt(F.lit(0.19))))
    return e.where("k IS NOT NULL").select(
        text("d", u % 3).alias("domain"), F.lpad(n.cast("string"), 8, "0").alias("node"), text("Title ", n).alias("title"), F.col("day").alias("start_day"), F.col("day").alias("end_day"), F.lit("day").alias("time_precision"),
        F.array(text("r", n)).alias("revisions"), F.array(text("company:", u, "w", F.floor(F.col("day") / 7))).alias("core_keys"), F.array(text("w:t", k % 4), text("w:u", k % 3)).alias("terms"),
        F.array().cast("array<struct<source:array<string>,target:array<string>,confidence:double>>").alias("claims"), F.array_compact(F.array(phase)).alias("phases"), said.alias("said"), F.array((k % 5).cast("string")).alias("numbers"),
        F.lit("corporate").alias("family"), vector.alias("vector"), (k % 11 == 0).alias("uncertain"), F.array(text("v", u * 7 + n % 3)).alias("sources"),
    )


EVENT_PHASES = {"view": "proposal", "click": "approval", "signup": "implementation", "purchase": "completion", "error": "delay"}


def _event_stories(s: SparkSession, d: str) -> Callable[[str], DataFrame]:
    def make() -> dict[str, DataFrame]:
        st = Stages(s, "event-stories")
        nodes = st.write(event_nodes(s, d))
        scored = st.write(S.scored_edges(st, nodes))
        stories, members, edges = S.build_stories(st, nodes, scored)
        return {"scored": scored, "stories": stories, "members": members, "edges": edges}

    return _published(s, d, "event-stories", make, ("events",))


_MOVES = ", ".join(f"('{a}', '{b}')" for a, b in S.vocab.PHASE_TRANSITIONS)
_EVENT_EDGES = f"""WITH RECURSIVE e AS (SELECT event_id, user_id AS u, event_type AS ty, CAST(ts AS DATE) - DATE '1970-01-01' AS day, CAST(props->>'$.k' AS BIGINT) AS k FROM events),
n AS (SELECT 'd' || (u % 3) AS domain, lpad(CAST(event_id AS VARCHAR), 8, '0') AS node, 'Title ' || event_id AS title, day, 'company:' || u || 'w' || (day // 7) AS key, k, ty, CASE ty {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in EVENT_PHASES.items())} END AS phase, 'v' || (u * 7 + event_id % 3) AS src FROM e WHERE k IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY domain, key ORDER BY day, node) AS pos FROM n),
p AS (SELECT a.domain, a.key, a.node AS source, b.node AS target, b.day - a.day AS gap, ((a.k % 4 = b.k % 4)::INT + (a.k % 3 = b.k % 3)::INT) / 2.0 AS claim, a.k % 5 = b.k % 5 AS numeric, CASE WHEN (a.phase, b.phase) IN ({_MOVES}) THEN 1.0 ELSE 0.0 END AS move,
  b.ty, CASE WHEN a.k % 2 = b.k % 2 THEN 1.0 ELSE 0.9 END AS cos, a.k % 11 = 0 OR b.k % 11 = 0 AS unsure, a.src <> b.src AS apart FROM o a JOIN o b ON a.domain = b.domain AND a.key = b.key AND b.pos > a.pos AND b.pos <= a.pos + 8),
r AS (SELECT *, CASE WHEN ty = 'error' AND claim >= 0.06 THEN 'corrects' WHEN ty = 'signup' AND claim >= 0.06 THEN 'response' WHEN gap > 0 AND move > 0 AND (claim >= 0.08 OR numeric) THEN 'continuation' END AS relation FROM p WHERE gap BETWEEN 0 AND 365),
c AS (SELECT *, round(CASE WHEN unsure THEN 0.85 ELSE 1.0 END * (0.24 * cos + 0.20 * least(1.0, claim / 0.25) + 0.15 + 0.12 + 0.12 * CASE relation WHEN 'continuation' THEN move ELSE 1.0 END + 0.10 + 0.07 * CASE WHEN apart THEN 1.0 ELSE 0.35 END)::DOUBLE, 6) AS confidence FROM r WHERE relation IS NOT NULL),
g AS (SELECT * FROM c WHERE confidence >= CASE relation WHEN 'continuation' THEN 0.82 ELSE 0.80 END)
"""
_EVENT_STORIES = _EVENT_EDGES + """, w AS (SELECT *, row_number() OVER (PARTITION BY domain, key, source ORDER BY confidence DESC, target) AS ko, row_number() OVER (PARTITION BY domain, key, target ORDER BY confidence DESC, source) AS ki FROM g),
h AS (SELECT * FROM w WHERE ko <= 3 AND ki <= 3),
l AS (SELECT domain, key, source AS a, target AS b FROM h UNION SELECT domain, key, target, source FROM h),
x AS (SELECT DISTINCT domain, key, a, a AS b FROM l UNION SELECT x.domain, x.key, x.a, l.b FROM x JOIN l ON l.domain = x.domain AND l.key = x.key AND l.a = x.b),
m AS (SELECT domain, key, a AS node, min(b) AS story FROM x GROUP BY ALL),
t AS (SELECT m.*, n.title, n.day, n.src FROM m JOIN n ON n.domain = m.domain AND n.node = m.node),
q AS (SELECT domain, key, story, count(*) AS n_members, count(DISTINCT src) AS n_sources, arg_min(title, (day, node)) AS first_title, arg_max(title, (day, node)) AS last_title FROM t GROUP BY ALL),
z AS (SELECT h.domain, h.key, m.story, avg(confidence) AS average, max(confidence) AS strongest, list_sort(list(DISTINCT relation)) AS types, count(*) AS n_edges FROM h JOIN m ON m.domain = h.domain AND m.key = h.key AND m.node = h.source GROUP BY ALL),
y AS (SELECT *, round(least(1.0, 0.80 * average + 0.10 * least(1.0, n_sources / 3) + 0.10 * least(1.0, len(types) / 2)), 6) AS quality FROM q JOIN z USING (domain, key, story)),
f AS (SELECT *, sha256(concat_ws('|', domain, key, story)) AS story_id, CASE WHEN n_members >= 4 AND n_sources >= 3 AND quality >= 0.82 THEN 'established' ELSE 'emerging' END AS maturity, substr(key, 9) AS name
  FROM y WHERE n_sources >= 2 AND CASE WHEN n_members = 2 THEN CASE WHEN types = ['continuation'] THEN strongest >= 0.92 ELSE strongest >= 0.84 END ELSE quality >= 0.76 END)
"""


@query(_EVENT_EDGES + "SELECT domain, source, target, key AS anchor_key, relation AS relation_type, confidence, CAST(gap AS INTEGER) AS gap_days FROM g")
def dm10_event_story_edges(s: SparkSession, d: str) -> DataFrame:
    return _event_stories(s, d)("scored").select("domain", "source", "target", "anchor_key", "relation_type", "confidence", "gap_days")


@query(_EVENT_STORIES + "SELECT t.domain, f.story_id, t.node, CAST(row_number() OVER (PARTITION BY f.story_id ORDER BY t.day, t.node) - 1 AS INTEGER) AS position FROM t JOIN f USING (domain, key, story)")
def dm12_event_story_members(s: SparkSession, d: str) -> DataFrame:
    return _event_stories(s, d)("members")


@query(_EVENT_STORIES + "SELECT domain, story_id, key AS anchor_key, CASE WHEN first_title = last_title THEN name || '：' || first_title ELSE name || '：' || first_title || ' → ' || last_title END AS label, maturity, round(quality, 4) AS quality_score, n_members, CAST(n_sources AS INTEGER) AS n_sources, n_edges FROM f")
def dm13_event_stories(s: SparkSession, d: str) -> DataFrame:
    return _event_stories(s, d)("stories").withColumn("quality_score", F.round("quality_score", 4))


@query(_EVENT_STORIES + """, k AS (SELECT f.story_id, f.domain, f.maturity, f.quality, h.source, h.target, h.relation, h.confidence FROM f JOIN m ON m.domain = f.domain AND m.key = f.key AND m.story = f.story JOIN h ON h.domain = m.domain AND h.key = m.key AND h.target = m.node)
SELECT domain, story_id, target AS node, source AS from_node, relation AS relation_type, confidence, 2 AS support, confidence >= 0.9 AS strong FROM k""")
def dm24_event_story_detail(s: SparkSession, d: str) -> DataFrame:
    """The edges of each story with the revisions that support them, strong ones marked."""
    c = _event_stories(s, d)
    return S.detail(c("scored"), c("edges")).select("domain", "story_id", F.col("target").alias("node"), F.col("source").alias("from_node"), "relation_type", "confidence", "support", "strong")


@query(_EVENT_STORIES + """, k AS (SELECT f.story_id, h.confidence, h.relation FROM f JOIN m ON m.domain = f.domain AND m.key = f.key AND m.story = f.story JOIN h ON h.domain = m.domain AND h.key = m.key AND h.target = m.node)
SELECT story_id, bool_or(confidence < 0.9) AS material, false AS reworded FROM k GROUP BY 1""")
def dm15_event_story_change(s: SparkSession, d: str) -> DataFrame:
    """Whether a story is news against a build that had only its strong edges, and against one that scored them otherwise:
    edges and their evidence count, scores do not."""
    c = _event_stories(s, d)
    none = F.array().cast("array<string>")
    e = S.detail(c("scored"), c("edges")).join(c("scored").select("domain", "source", "target", "revisions"), ["domain", "source", "target"])
    edge = lambda score: F.struct("source", "target", "relation_type", F.lit("forward").alias("direction"), F.lit("active").alias("status"), "revisions", none.alias("claims"), score.alias("score"))
    # A story has a few edges a node.
    per = e.groupBy("story_id").agg(F.collect_list(edge(F.col("confidence"))).alias("now"), F.collect_list(F.when(F.col("strong"), edge(F.col("confidence")))).alias("strong"), F.collect_list(edge(F.col("confidence") / 2)).alias("rescored"))
    members = c("members").groupBy("story_id").agg(F.array_sort(F.collect_list("node")).alias("members"))
    j = per.join(members, "story_id").join(c("stories").select("story_id", "maturity"), "story_id")
    form = lambda edges: S.material_form(F.col("members"), F.col("maturity"), F.col(edges))
    return j.select("story_id", (form("now") != form("strong")).alias("material"), (form("now") != form("rescored")).alias("reworded"))


@query(_EVENT_STORIES + """, d AS (SELECT f.domain, f.story_id, f.quality, max(t.day) AS last_day FROM f JOIN t USING (domain, key, story) GROUP BY ALL), k AS (SELECT domain, story_id, last_day, row_number() OVER (PARTITION BY domain ORDER BY last_day DESC, quality DESC, story_id) AS place FROM d)
SELECT domain, story_id, CAST(last_day AS INTEGER) AS last_day, CAST(place AS INTEGER) AS place, last_day > 19740 AS unread FROM k WHERE place <= 25""")
def dm24_event_story_directory(s: SparkSession, d: str, read_until: int = 19_740) -> DataFrame:
    """The newest stories of each domain, and whether they have gone on since they were read."""
    c = _event_stories(s, d)
    return S.directory(c("stories"), c("members"), event_nodes(s, d), F.lit(read_until), 25)


@query("""SELECT DISTINCT b.id, b.object_id, r.event_id, v.status AS source_status FROM brief_reference b LEFT JOIN event_record r ON r.revision_id = lower(trim(b.object_id)) LEFT JOIN video v ON v.id = r.source_video_id WHERE b.object_type = 'evidence'""")
def dm25_evidence_context(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "brief_reference").where("object_type = 'evidence'").withColumn("k", F.lower(F.trim("object_id"))).select("id", "object_id", "k")
    r = table(s, d, "event_record").select(F.col("revision_id").alias("k"), "event_id", "source_video_id").distinct()
    v = table(s, d, "video").select(F.col("id").alias("source_video_id"), F.col("status").alias("source_status")).distinct()
    return b.join(r, "k", "left").join(v, "source_video_id", "left").select("id", "object_id", "event_id", "source_status").distinct()


@query("""WITH x AS (SELECT DISTINCT id, brief_id, object_type, object_id, position FROM brief_reference), r AS (SELECT *, row_number() OVER (PARTITION BY brief_id, object_type ORDER BY position, id) AS k FROM x)
SELECT brief_id, object_type, id FROM r WHERE k <= CASE object_type WHEN 'canonical' THEN 12 ELSE 4 END""")
def dm26_brief_references(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "brief_reference").select("id", "brief_id", "object_type", "object_id", "position").distinct()
    top = R.first_per_key(x, ["brief_id", "object_type"], [F.col("position"), F.col("id")], 12, "k")
    return top.where((F.col("object_type") == "canonical") | (F.col("k") <= 4)).select("brief_id", "object_type", "id")


@query("SELECT lower(trim(object_id)) AS object_id, count(DISTINCT brief_id) AS briefs, max(created_at) AS latest FROM brief_reference GROUP BY 1")
def dm27_object_references(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "brief_reference").groupBy(F.lower(F.trim("object_id")).alias("object_id")).agg(F.countDistinct("brief_id").alias("briefs"), F.max("created_at").alias("latest"))


@query(f"""WITH k AS ({_CURRENT}) SELECT k.playlist_id, count(*) AS n, min(event_start_day) AS first_day, max(event_end_day) AS last_day, count(*) FILTER (has_uncertainty) AS uncertain FROM k LEFT JOIN (SELECT DISTINCT snapshot_id, canonical_id, event_start_day, event_end_day, has_uncertainty FROM event_map_canonical) c ON c.snapshot_id = k.id GROUP BY 1""")
def dm28_domain_manifest(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "event_map_canonical").select("snapshot_id", "canonical_id", "event_start_day", "event_end_day", "has_uncertainty").distinct()
    j = current(s, d).join(c, "snapshot_id", "left")
    return j.groupBy("playlist_id").agg(F.count("*").alias("n"), F.min("event_start_day").alias("first_day"), F.max("event_end_day").alias("last_day"), F.count_if(F.col("has_uncertainty")).alias("uncertain"))


@query("""SELECT video_id, id FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(video_id)) ORDER BY CASE source WHEN 'platform' THEN 0 WHEN 'upload' THEN 1 ELSE 2 END, CASE variant WHEN 'clean' THEN 0 ELSE 1 END, created_at DESC, id DESC) AS k FROM (SELECT DISTINCT id, lower(trim(video_id)) AS video_id, source, variant, created_at FROM asset WHERE type = 'transcript' AND video_id IS NOT NULL)) WHERE k = 1""")
def dm29_transcript_choice(s: SparkSession, d: str) -> DataFrame:
    from tidemark.functions.text import lookup

    a = table(s, d, "asset").where("type = 'transcript' AND video_id IS NOT NULL").select("id", F.lower(F.trim("video_id")).alias("video_id"), "source", "variant", "created_at").distinct()
    rank = F.coalesce(lookup({"platform": 0, "upload": 1}, F.col("source")), F.lit(2))
    clean = F.when(F.col("variant") == "clean", 0).otherwise(1)
    return R.first_per_key(a, ["video_id"], [rank, clean, F.desc("created_at"), F.desc("id")]).select("video_id", "id")


@query("""WITH v AS (SELECT DISTINCT id, media_id, published_at, status FROM video) SELECT CAST(date_trunc('week', published_at) AS DATE) AS week, id, CASE WHEN status = 'deleted' THEN 'deleted' WHEN id NOT IN (SELECT video_id FROM asset WHERE type = 'transcript' AND video_id IS NOT NULL) THEN 'no_transcript' ELSE 'ready' END AS state FROM v WHERE published_at IS NOT NULL""")
def dm30_brief_inputs(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "asset").where("type = 'transcript'").select(F.col("video_id").alias("id"), F.lit(True).alias("has")).distinct()
    v = table(s, d, "video").where("published_at IS NOT NULL").select("id", "published_at", "status", "media_id").distinct().join(t, "id", "left")
    state = F.when(F.col("status") == "deleted", "deleted").when(F.col("has").isNull(), "no_transcript").otherwise("ready")
    return v.select(F.date_trunc("week", F.col("published_at").cast("timestamp")).cast("date").alias("week"), "id", state.alias("state"))


@query("""WITH RECURSIVE v AS (SELECT DISTINCT coalesce(media_id, '') AS media_id, id, CAST(length(description) AS BIGINT) AS chars FROM video WHERE status = 'ready' AND description IS NOT NULL AND id NOT IN (SELECT source_video_id FROM event_record WHERE source_video_id IS NOT NULL)),
o AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY id, chars) AS n FROM v),
b AS (SELECT media_id, id, chars, n, 0 AS batch, chars AS used FROM o WHERE n = 1
  UNION ALL SELECT o.media_id, o.id, o.chars, o.n, CASE WHEN b.used > 0 AND b.used + o.chars > 10000 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.used > 0 AND b.used + o.chars > 10000 THEN o.chars ELSE b.used + o.chars END FROM b JOIN o ON o.media_id = b.media_id AND o.n = b.n + 1)
SELECT media_id, id, chars, batch FROM b""")
def dm31_extraction_batches(s: SparkSession, d: str) -> DataFrame:
    """Batches of the videos of each source that have not been extracted yet."""
    from tidemark.functions.chunking import packed

    done = table(s, d, "event_record").where("source_video_id IS NOT NULL").select(F.col("source_video_id").alias("id")).distinct()
    v = table(s, d, "video").where("status = 'ready' AND description IS NOT NULL").select(F.coalesce("media_id", F.lit("")).alias("media_id"), "id", F.length("description").alias("chars")).distinct()
    return packed(v.join(done, "id", "left_anti"), "media_id", "id", "chars", 10_000)


@query("SELECT CAST(unnest(generate_series(date_trunc('month', DATE '2024-01-15'), date_trunc('month', DATE '2026-06-10'), INTERVAL 1 MONTH)) AS DATE) AS month_start")
def dm32_month_ranges(s: SparkSession, d: str) -> DataFrame:
    from tidemark.functions.times import spine

    return s.range(1).select(F.explode(spine(F.lit("2024-01-15").cast("date"), F.lit("2026-06-10").cast("date"), "month")).alias("month_start"))


@query("SELECT DISTINCT event_id, CASE WHEN list_max(list_transform(evidence, lambda e: e.confidence)) >= 0.8 AND len(evidence) > 0 THEN 'accepted' ELSE 'draft' END AS state FROM event_record")
def dm33_acceptance(s: SparkSession, d: str) -> DataFrame:
    best = F.array_max(F.transform("evidence", lambda e: e["confidence"]))
    return table(s, d, "event_record").select("event_id", F.when((best >= 0.8) & (F.size("evidence") > 0), "accepted").otherwise("draft").alias("state")).distinct()


@query("SELECT event_id, e.entity_type, e.key, e.role, max(e.confidence) AS confidence FROM (SELECT event_id, unnest(entities) AS e FROM event_record) GROUP BY ALL")
def dm34_child_rows(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "event_record").select("event_id", F.explode("entities").alias("e"))
    return e.groupBy("event_id", "e.entity_type", "e.key", "e.role").agg(F.max("e.confidence").alias("confidence"))


@query("SELECT brief_id, max(created_at) AS latest, count(DISTINCT id) AS refs FROM brief_reference GROUP BY 1")
def dm35_latest_briefs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "brief_reference").groupBy("brief_id").agg(F.max("created_at").alias("latest"), F.countDistinct("id").alias("refs"))


@query("SELECT 'media' AS kind, count(DISTINCT id) AS n FROM media UNION ALL SELECT 'video', count(DISTINCT id) FROM video UNION ALL SELECT 'asset', count(DISTINCT id) FROM asset UNION ALL SELECT 'event', count(DISTINCT event_id) FROM event_record UNION ALL SELECT 'snapshot', count(DISTINCT id) FROM event_map_snapshot")
def dm36_overview(s: SparkSession, d: str) -> DataFrame:
    n = lambda t, c: table(s, d, t).agg(F.countDistinct(c).alias("n"))
    return R.tagged_union({"media": n("media", "id"), "video": n("video", "id"), "asset": n("asset", "id"), "event": n("event_record", "event_id"), "snapshot": n("event_map_snapshot", "id")})


@query("SELECT DISTINCT v.id FROM video v WHERE v.id IN (SELECT source_video_id FROM event_record WHERE playlist_id IN (SELECT playlist_id FROM event_map_snapshot WHERE status = 'ready'))")
def dm37_enabled_videos(s: SparkSession, d: str) -> DataFrame:
    on = table(s, d, "event_map_snapshot").where("status = 'ready'").select("playlist_id")
    r = R.within(table(s, d, "event_record"), on, ["playlist_id"]).select(F.col("source_video_id").alias("id"))
    return R.within(table(s, d, "video"), r, ["id"]).select("id").distinct()


@query("SELECT DISTINCT r.playlist_id, CAST(date_trunc('week', v.published_at) AS DATE) AS period_start FROM video v JOIN event_record r ON r.source_video_id = v.id WHERE v.status = 'deleted' AND v.published_at IS NOT NULL")
def dm38_affected_periods(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "video").where("status = 'deleted' AND published_at IS NOT NULL").select(F.col("id").alias("source_video_id"), F.date_trunc("week", F.col("published_at").cast("timestamp")).cast("date").alias("period_start"))
    return table(s, d, "event_record").select("playlist_id", "source_video_id").join(v, "source_video_id").select("playlist_id", "period_start").distinct()


@query("""SELECT 'by_video' AS family, a.id FROM asset a WHERE a.video_id IN (SELECT id FROM video WHERE status = 'deleted') UNION SELECT 'by_evidence', e.id FROM video_time_evidence e WHERE e.video_id IN (SELECT id FROM video WHERE status = 'deleted')
UNION SELECT 'by_reference', b.id FROM brief_reference b WHERE b.object_id IN (SELECT id FROM video WHERE status = 'deleted')""")
def dm39_related_rows(s: SparkSession, d: str) -> DataFrame:
    gone = table(s, d, "video").where("status = 'deleted'").select("id")
    part = lambda t, c: R.within(table(s, d, t), gone.withColumnRenamed("id", c), [c]).select("id") if c != "id" else None
    return R.tagged_union({"by_video": part("asset", "video_id"), "by_evidence": part("video_time_evidence", "video_id"), "by_reference": part("brief_reference", "object_id")}, "family").distinct()
