"""Stories: evidence-backed chains of events.

Nodes are canonical events with what their reports say together; edges join an event to one of the next few of the
same entity, by a fixed order of relations; strong edges around an anchor entity grow stories.

Entity names are taken out of a claim by the names of the record that states it. Stories of more than ``MOST`` nodes
are grown edge by edge by strength; a component within that size needs no order, as every edge is accepted.

Cases: events without evidence or with year precision join nothing; null days join nothing; ties go to the smaller id;
empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import vectors as V
from tidemark.functions import vocab
from tidemark.operators.matching import greedy_matching, labelled_components
from tidemark.operators.relational import ranked_lookahead
from tidemark.session import Stages

MOST, AHEAD, GAP, DEGREE = 48, 8, 365, 3


def degree_capped(edges: DataFrame, keys: Sequence[str], source: str, target: str, weight: str, most: int = DEGREE) -> DataFrame:
    """Edges among the ``most`` strongest of both their ends, counted within ``keys`` before any is dropped."""
    out = Window.partitionBy(*keys, source).orderBy(F.desc(weight), target)
    into = Window.partitionBy(*keys, target).orderBy(F.desc(weight), source)
    ranked = edges.withColumns({"_out": F.row_number().over(out), "_in": F.row_number().over(into)})
    return ranked.where((F.col("_out") <= most) & (F.col("_in") <= most)).drop("_out", "_in")


def profiles(prepared: DataFrame, members: DataFrame, groups: DataFrame) -> DataFrame:
    """One row an event: domain, node (the representative), days, core keys, claim terms, phases, numbers, sources,
    supporting revisions, claims of its relations, family, precision, vector, uncertainty."""
    names = F.coalesce(F.transform("entities", lambda e: F.coalesce(e["name"], F.lit(""))), F.array().cast("array<string>"))
    # Blank texts are no evidence; a relation that states something is.
    said = lambda x: F.length(F.trim(F.coalesce(x, F.lit("")))) > 0
    support = F.exists(F.coalesce("evidence", F.array()), lambda e: said(e["evidence_text"])) | F.exists(F.coalesce("relations", F.array()), lambda r: said(r["evidence_text"]) | said(r["source_claim"]) | said(r["target_claim"]))
    causal = F.filter(F.coalesce("relations", F.array()), lambda r: F.lower(r["relation_type"]).isin("cause", "causes", "effect", "affects") & said(r["source_claim"]) & said(r["target_claim"]))
    claims = F.transform(causal, lambda r: F.struct(X.claim_terms(r["source_claim"]).alias("source"), X.claim_terms(r["target_claim"]).alias("target"), F.coalesce(r["confidence"], F.lit(0.75)).alias("confidence")))
    rec = prepared.select(
        "domain", "event_id", "start_day", "end_day", "core_keys", "numbers", "folded", X.claim_terms(F.col("folded"), names).alias("terms"), X.phases(F.col("folded")).alias("phases"),
        F.array_compact(F.concat(F.array("source_video_id"), F.coalesce("evidence.video_id", F.array().cast("array<string>")))).alias("sources"), F.when(support, F.col("revision_id")).alias("revision"), claims.alias("claims"),
    )
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    m = rec.join(members.select("domain", "event_id", "group_id"), ["domain", "event_id"])
    # A group has at most a hundred members.
    node = m.groupBy("domain", "group_id").agg(
        F.min("start_day").alias("start_day"), F.max("end_day").alias("end_day"), union("core_keys"), union("numbers"), union("terms"), union("phases"), union("sources"),
        F.array_sort(F.collect_set("revision")).alias("revisions"), F.flatten(F.collect_list("claims")).alias("claims"), F.concat_ws(" ", F.array_sort(F.collect_list("folded"))).alias("said"),
    )
    head = prepared.select("domain", F.col("event_id").alias("node"), "title", "time_precision", X.semantic_family("event_type").alias("family"), "vector")
    g = groups.select("domain", "group_id", F.col("representative").alias("node"), (F.size("flags") > 0).alias("uncertain"))
    return node.join(g, ["domain", "group_id"]).join(head, ["domain", "node"])


def _has_transition(a: Column, b: Column) -> Column:
    moves = [F.array_contains(a, x) & F.array_contains(b, y) for x, y in vocab.PHASE_TRANSITIONS]
    any_move = moves[0]
    for m in moves[1:]:
        any_move = any_move | m
    turn = F.array(F.lit("increase"), F.lit("decrease"))
    return F.when(any_move, 1.0).when(F.arrays_overlap(a, turn) & F.arrays_overlap(b, turn), 0.65).otherwise(0.0)


def scored_edges(st: Stages, nodes: DataFrame) -> DataFrame:
    """domain, source, target, anchor_key, relation_type, confidence, and what it rests on; the strongest a pair."""
    slim = nodes.select("domain", "node", "start_day", F.explode("core_keys").alias("entity")).withColumn("k", F.struct("domain", "entity"))
    pairs = ranked_lookahead(slim, "k", [F.col("start_day"), F.col("node")], "node", AHEAD).select(F.col("k.domain").alias("domain"), "source", "target").distinct()
    a, b = nodes.alias("a"), nodes.alias("b")
    j = pairs.join(a, (pairs["domain"] == F.col("a.domain")) & (pairs["source"] == F.col("a.node"))).join(b, (pairs["domain"] == F.col("b.domain")) & (pairs["target"] == F.col("b.node")))
    c = F.col
    gap = c("b.start_day") - c("a.end_day")
    shared = F.array_intersect("a.core_keys", "b.core_keys")
    kind = lambda k: F.when(k.contains(":"), F.substring_index(k, ":", 1)).otherwise("other")
    best = F.array_min(F.transform(shared, lambda k: F.struct((-F.coalesce(X.lookup(vocab.ENTITY_PRIORITY, kind(k)), F.lit(0))).alias("p"), k.alias("k"))))["k"]
    claim = X.overlap_of_smaller(c("a.terms"), c("b.terms"))
    bridge = F.coalesce(F.array_max(F.transform(F.concat("a.claims", "b.claims"), lambda r: F.least(X.overlap_of_smaller(c("a.terms"), r["source"]), X.overlap_of_smaller(c("b.terms"), r["target"])) * r["confidence"])), F.lit(0.0))
    j = j.where(gap.between(0, GAP) & (F.coalesce("a.time_precision", F.lit("")) != "year") & (F.coalesce("b.time_precision", F.lit("")) != "year") & (F.size("a.revisions") > 0) & (F.size("b.revisions") > 0) & (F.size(shared) > 0))
    j = j.select(
        pairs["domain"].alias("domain"), "source", "target", gap.alias("gap_days"), F.array_sort(shared).alias("shared"), best.alias("anchor_key"), claim.alias("claim_overlap"), bridge.alias("bridge"),
        _has_transition(c("a.phases"), c("b.phases")).alias("phase"), X.first_cue(c("b.said"), vocab.CORRECTION_CUES).alias("correction"), X.first_cue(c("b.said"), vocab.RESPONSE_CUES).alias("response_cue"),
        F.arrays_overlap("a.numbers", "b.numbers").alias("numeric"), (c("a.family") == c("b.family")).alias("same_family"), V.cosine(c("a.vector"), c("b.vector")).alias("cosine"),
        (F.size(shared) / F.greatest(F.least(F.size("a.core_keys"), F.size("b.core_keys")), F.lit(1))).alias("entity_overlap"), (c("a.uncertain") | c("b.uncertain")).alias("uncertain"),
        (F.array_sort("a.sources") != F.array_sort("b.sources")).alias("distinct_sources"), F.slice(F.array_sort(F.array_union("a.revisions", "b.revisions")), 1, 12).alias("revisions"),
    )
    # Written once, as every rule below reads the overlaps again.
    j = st.write(j)
    specific = ~kind(c("anchor_key")).isin(vocab.GENERIC_ENTITY_TYPES)
    states = (c("claim_overlap") >= 0.06) | (c("bridge") >= 0.12)
    relation = (
        F.when(c("correction").isNotNull() & states, "corrects")
        .when(c("bridge") >= 0.18, "causes")
        .when(c("response_cue").isNotNull() & states, "response")
        .when((c("gap_days") > 0) & c("same_family") & (c("phase") > 0) & ((c("claim_overlap") >= 0.08) | c("numeric")), "continuation")
    )
    j = j.withColumns({"relation_type": relation, "specific": specific}).where("relation_type IS NOT NULL")
    least = X.lookup({"corrects": 0.72, "causes": 0.68, "response": 0.72, "continuation": 0.80}, c("relation_type"))
    j = j.where((c("cosine") >= least) & ~((c("relation_type") == "continuation") & ~c("specific") & ((c("claim_overlap") < 0.16) | (c("cosine") < 0.88))))
    strength = F.when(c("relation_type") == "causes", F.least(F.lit(1.0), c("bridge") / 0.35)).when(c("relation_type") == "continuation", c("phase")).otherwise(1.0)
    total = (
        0.24 * c("cosine") + 0.20 * F.greatest(F.least(F.lit(1.0), c("claim_overlap") / 0.25), c("bridge")) + 0.15 * c("entity_overlap")
        + 0.12 * F.when(c("specific"), 1.0).otherwise(0.35) + 0.12 * strength + 0.10 + 0.07 * F.when(c("distinct_sources"), 1.0).otherwise(0.35)
    )
    j = j.withColumn("confidence", F.round(F.when(c("uncertain"), 0.85).otherwise(1.0) * total, 6))
    need = F.when(c("relation_type") == "causes", 0.78).when(c("relation_type") == "continuation", 0.82).otherwise(0.80)
    return j.where(c("confidence") >= need).drop("correction", "response_cue", "same_family", "uncertain", "phase")


def _grown(f: pd.DataFrame) -> pd.DataFrame:
    """Union of edges by strength, none of which may make a story of more than ``MOST`` nodes."""
    f = f.sort_values(["confidence", "source", "target"], ascending=[False, True, True], kind="stable")
    parent: dict[str, str] = {}
    size: dict[str, int] = {}

    def root(x: str) -> str:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for i, a, b in zip(f.index, f["source"], f["target"]):
        a, b = root(a), root(b)
        if a != b:
            if size.get(a, 1) + size.get(b, 1) > MOST:
                continue
            a, b = (a, b) if size.get(a, 1) >= size.get(b, 1) else (b, a)
            parent[b], size[a] = a, size.get(a, 1) + size.get(b, 1)
        kept.append(i)
    out = f.loc[kept]
    first = {}
    for x in sorted({*out["source"], *out["target"]}):
        first.setdefault(root(x), x)
    return out.assign(story=[first[root(x)] for x in out["source"]])[["domain", "anchor_key", "source", "target", "story"]]


def build_stories(st: Stages, nodes: DataFrame, scored: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From nodes, and their ``scored_edges`` where those are made already. stories: domain, story_id, anchor_key, maturity, quality_score, counts; members: domain, story_id, node,
    position; edges with their story."""
    edges = st.write(degree_capped(scored_edges(st, nodes) if scored is None else scored, ["domain", "anchor_key"], "source", "target", "confidence"))
    key = lambda n: F.concat_ws("\u0001", "domain", "anchor_key", n)
    comp = labelled_components(st, edges.select(key("source").alias("u"), key("target").alias("v")), "u", "v")
    sized = comp.join(comp.groupBy("component").agg(F.count("*").alias("n")), "component").select(F.col("node").alias("k"), "component", "n")
    e = edges.withColumn("k", key("source")).join(sized, "k").drop("k")
    small = e.where(F.col("n") <= MOST).select("domain", "anchor_key", "source", "target", F.element_at(F.split("component", "\u0001"), -1).alias("story"))
    # Only components above the limit need an order; a row of them is five short columns.
    large = e.where(F.col("n") > MOST).select("domain", "anchor_key", "source", "target", "confidence", "component")
    grown = large.groupBy("component").applyInPandas(_grown, "domain string, anchor_key string, source string, target string, story string")
    placed = st.write(edges.join(small.unionByName(grown), ["domain", "anchor_key", "source", "target"]))
    by = ["domain", "anchor_key", "story"]
    member = placed.select(*by, F.col("source").alias("node")).unionByName(placed.select(*by, F.col("target").alias("node"))).distinct().join(nodes.select("domain", "node", "start_day", "title", "sources"), ["domain", "node"])
    m = member.groupBy(*by).agg(F.count("*").alias("n_members"), F.size(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("n_sources"), F.min_by("title", F.struct("start_day", "node")).alias("first_title"), F.max_by("title", F.struct("start_day", "node")).alias("last_title"))
    s = placed.groupBy(*by).agg(F.avg("confidence").alias("average"), F.max("confidence").alias("strongest"), F.collect_set("relation_type").alias("types"), F.count("*").alias("n_edges")).join(m, by)
    quality = F.round(F.least(F.lit(1.0), 0.80 * F.col("average") + 0.10 * F.least(F.lit(1.0), F.col("n_sources") / 3) + 0.10 * F.least(F.lit(1.0), F.size("types") / 2)), 6)
    s = s.withColumn("quality_score", quality)
    kind = F.substring_index("anchor_key", ":", 1)
    enough = F.col("n_sources") >= 2
    two = F.when(F.array_contains("types", "continuation") & (F.size("types") == 1), (F.col("strongest") >= 0.92) & ~kind.isin(vocab.GENERIC_ENTITY_TYPES)).otherwise(F.col("strongest") >= 0.84)
    s = s.where(enough & F.when(F.col("n_members") == 2, two).otherwise(F.col("quality_score") >= 0.76))
    maturity = F.when((F.col("n_members") >= 4) & (F.col("n_sources") >= 3) & (F.col("quality_score") >= 0.82), "established").otherwise("emerging")
    name = F.substring_index("anchor_key", ":", -1)
    label = F.substring(F.when(F.col("first_title") == F.col("last_title"), F.concat(name, F.lit("："), X.title_part(F.col("first_title"), name))).otherwise(F.concat(name, F.lit("："), X.title_part(F.col("first_title"), name), F.lit(" → "), X.title_part(F.col("last_title"), name))), 1, 120)
    s = st.write(s.withColumns({"story_id": F.sha2(F.concat_ws("|", *by), 256), "maturity": maturity, "label": label}))
    w = Window.partitionBy("story_id").orderBy("start_day", "node")
    members = member.join(s.select(*by, "story_id"), by).select("domain", "story_id", "node", (F.row_number().over(w) - 1).alias("position"))
    return s.select("domain", "story_id", "anchor_key", "label", "maturity", "quality_score", "n_members", "n_sources", "n_edges"), members, placed.join(s.select(*by, "story_id"), by)


def detail(scored: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges of stories with what they rest on: domain, story_id, source, target, relation_type, confidence, support
    (revisions of both ends, twelve at most) and strong."""
    keys = ["domain", "anchor_key", "source", "target"]
    said = scored.select(*keys, "relation_type", "confidence", F.size("revisions").alias("support"))
    return edges.select(*keys, "story_id").join(said, keys).withColumn("strong", F.col("confidence") >= 0.9).drop("anchor_key")


def directory(stories: DataFrame, members: DataFrame, nodes: DataFrame, read_until: Column, most: int) -> DataFrame:
    """domain, story_id, last_day, place, unread: the stories of each domain that went on last, at most ``most``, and
    whether an event of theirs is newer than the day up to which their reader has read."""
    last = members.join(nodes.select("domain", "node", "start_day"), ["domain", "node"]).groupBy("domain", "story_id").agg(F.max("start_day").alias("last_day"))
    w = Window.partitionBy("domain").orderBy(F.desc("last_day"), F.desc("quality_score"), "story_id")
    placed = stories.select("domain", "story_id", "quality_score").join(last, ["domain", "story_id"]).withColumn("place", F.row_number().over(w))
    return placed.where(F.col("place") <= most).select("domain", "story_id", "last_day", "place", (F.col("last_day") > read_until).alias("unread"))


def story_identities(st: Stages, members: DataFrame, previous: DataFrame) -> DataFrame:
    """members and previous: anchor_key, story, canonical_id. Carries identities over between stories of one anchor
    whose overlap is at least one half, the best first: story, identity, state."""
    size = lambda df: df.groupBy("anchor_key", "story").agg(F.countDistinct("canonical_id").alias("n"))
    now, old = members.distinct(), previous.select("anchor_key", F.col("story").alias("identity"), "canonical_id").distinct()
    common = now.join(old, ["anchor_key", "canonical_id"]).groupBy("anchor_key", "story", "identity").agg(F.count("*").alias("common"))
    c = common.join(size(now), ["anchor_key", "story"]).join(size(previous.distinct()).select("anchor_key", F.col("story").alias("identity"), F.col("n").alias("was")), ["anchor_key", "identity"])
    score = F.greatest(F.col("common") / (F.col("n") + F.col("was") - F.col("common")), F.col("common") / F.least("n", "was"))
    pairs = c.withColumn("score", score).where("score >= 0.5").select(F.concat(F.lit("s"), "story").alias("x"), F.concat(F.lit("i"), "identity").alias("y"), "story", "identity", F.struct((-F.col("score")).alias("s"), (-F.col("common")).alias("c"), "identity", "story").alias("turn"))
    kept = greedy_matching(st, pairs, "x", "y", "turn").select("story", "identity")
    stories = members.select("story").distinct()
    return stories.join(kept, "story", "left").select("story", F.coalesce("identity", "story").alias("identity"), F.when(F.col("identity").isNotNull(), "retained").otherwise("new").alias("state"))


def material_form(members: Column, maturity: Column, edges: Column) -> Column:
    """What of a story counts as news: its members, its maturity, and the ends, kinds, states and evidence of its
    edges; wording and scores do not. edges: source, target, relation_type, direction, status, revisions, claims."""
    said = F.array_sort(F.transform(edges, lambda e: F.struct(*[F.coalesce(e[c], F.lit("")).alias(c) for c in ("source", "target", "relation_type", "direction", "status")], F.array_sort(F.array_distinct(e["revisions"])).alias("revisions"), F.array_sort(F.array_distinct(e["claims"])).alias("claims"))))
    return F.sha2(F.to_json(F.struct(members.alias("members"), maturity.alias("maturity"), said.alias("edges")), {"ignoreNullFields": "false"}), 256)
