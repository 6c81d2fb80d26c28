"""From reports to events: exact fingerprints, cautious fuzzy merges, identities that outlive a build, and lineage.

Records: domain, event_id, title, summary, event_type, direction, start_day, end_day, time_precision, entities,
vector; an event_id once a domain. Neighbours: left, right, similarity within a domain, as a similarity search gives
them; a neighbour that is listed twice is its own runner-up, so lists are never made distinct.

A fuzzy merge joins two exact groups, each of them once. Because of that the check of a pair never depends on other
merges, and the greedy order reduces to a matching in rounds (``matching``), without collecting a domain anywhere.

Cases: records without days never overlap in time; empty sets of entities overlap by nothing; empty numbers conflict
with nothing; ties go to the smaller id; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import vectors as V
from tidemark.functions import vocab
from tidemark.operators.groups import medoids
from tidemark.operators.matching import greedy_matching
from tidemark.session import Stages

MARGIN, MOST_MEMBERS = 0.05, 100
NAMESPACE = "6ba7b812-9dad-11d1-80b4-00c04fd430c8"


def prepare(records: DataFrame) -> DataFrame:
    """Adds what comparisons use: core entity keys, numbers, normal forms and the exact key."""
    core = F.filter(F.coalesce("entities", F.array()), lambda e: ~F.coalesce(e["role"], F.lit("")).isin(vocab.IGNORED_ROLES))
    exploded = records.select("domain", "event_id", F.explode(core).alias("e")).select("domain", "event_id", X.entity_key("e.entity_type", "e.name", "e.key").alias("k"))
    # Without a filter on the keys, which would fold every name once more for its test.
    keys = exploded.groupBy("domain", "event_id").agg(F.array_sort(F.collect_set(F.nullif("k", F.lit("")))).alias("core_keys"))
    text = X.nfkc_fold(F.concat_ws(" ", "title", "summary"))
    out = records.join(keys, ["domain", "event_id"], "left").withColumns({
        "core_keys": F.coalesce("core_keys", F.array().cast("array<string>")), "folded": text, "n_type": F.coalesce(F.nullif(X.normalize_text("event_type"), F.lit("")), F.lit("other")),
        "n_direction": X.normalize_text("direction"), "n_title": X.normalize_text("title"), "n_precision": X.normalize_text("time_precision"),
    }).withColumn("numbers", X.numeric_signature(F.col("folded")))
    parts = ["start_day", "end_day", "n_precision", "n_type", "n_direction", "core_keys", "n_title", "numbers"]
    return out.withColumn("exact_key", F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256))


def exact_groups(prepared: DataFrame) -> DataFrame:
    """domain, event_id, exact_group: the smallest id of the records with one fingerprint."""
    first = prepared.groupBy("domain", "exact_key").agg(F.min("event_id").alias("exact_group"), F.count("*").alias("exact_size"))
    return prepared.select("domain", "event_id", "exact_key").join(first, ["domain", "exact_key"]).drop("exact_key")


def refusal(a: str, b: str) -> tuple:
    """Why two prepared records may not merge (null: they may), and the similarity that they need."""
    c = lambda s, n: F.col(f"{s}.{n}")
    compatible = (c(a, "n_type") == c(b, "n_type")) | F.exists(
        F.array(*[F.array(F.lit(x.replace("_", "")), F.lit(y.replace("_", ""))) for x, y in vocab.COMPATIBLE_TYPES]),
        lambda p: F.array_contains(p, c(a, "n_type")) & F.array_contains(p, c(b, "n_type")),
    )
    neutral = lambda s: c(s, "n_direction").isin(vocab.NEUTRAL_DIRECTIONS)
    apart = F.greatest(c(a, "start_day"), c(b, "start_day")) > F.least(c(a, "end_day"), c(b, "end_day"))
    known = c(a, "start_day").isNotNull() & c(b, "start_day").isNotNull() & c(a, "end_day").isNotNull() & c(b, "end_day").isNotNull()
    reason = (
        F.when(~known | apart, "time_disjoint")
        .when((c(a, "time_precision") == "year") | (c(b, "time_precision") == "year"), "year_precision_exact_only")
        .when(~compatible, "event_type_conflict")
        .when(~neutral(a) & ~neutral(b) & (c(a, "n_direction") != c(b, "n_direction")), "direction_conflict")
        .when(X.jaccard(c(a, "core_keys"), c(b, "core_keys")) < 0.5, "core_entity_overlap_below_0.5")
        .when(X.numeric_conflict(c(a, "numbers"), c(b, "numbers")), "numeric_or_period_conflict")
    )
    month = (F.coalesce(c(a, "time_precision"), F.lit("")) == "month") | (F.coalesce(c(b, "time_precision"), F.lit("")) == "month")
    return reason, F.when(month, 0.90).otherwise(0.85)


COMPARED = ["domain", "event_id", "n_type", "n_direction", "start_day", "end_day", "time_precision", "core_keys", "numbers"]


def canonicalize(st: Stages, records: DataFrame, neighbours: DataFrame, prepared: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """From records, and their ``prepare``d form where that is written already. members: domain, event_id, group_id, rule, score, runner_up. groups: domain, group_id, representative, size,
    flags."""
    p = st.write(prepare(records)) if prepared is None else prepared
    exact = st.write(exact_groups(p))
    slim = p.select(*COMPARED).join(exact, ["domain", "event_id"])
    both = neighbours.select(F.col("domain").alias("d"), "left", "right", "similarity").where("left <> right")
    j = both.join(slim.alias("a"), (F.col("d") == F.col("a.domain")) & (F.col("left") == F.col("a.event_id"))).join(slim.alias("b"), (F.col("d") == F.col("b.domain")) & (F.col("right") == F.col("b.event_id")))
    reason, need = refusal("a", "b")
    ok = j.where(F.col("a.exact_group") != F.col("b.exact_group")).where(reason.isNull() & (F.col("similarity") >= need))
    ok = ok.select(F.col("d").alias("domain"), "left", "right", "similarity", F.col("a.exact_group").alias("left_group"), F.col("b.exact_group").alias("right_group"))
    w = Window.partitionBy("domain", "left").orderBy(F.desc("similarity"), "right")
    top = ok.withColumn("place", F.row_number().over(w)).where("place <= 2")
    pick = lambda k, c: F.max(F.when(F.col("place") == k, F.col(c)))
    best = st.write(top.groupBy("domain", "left").agg(pick(1, "right").alias("target"), pick(1, "similarity").alias("best"), pick(2, "similarity").alias("runner_up"), pick(1, "left_group").alias("own_group"), pick(1, "right_group").alias("target_group")))
    unsure = F.coalesce(F.col("best") - F.col("runner_up") < MARGIN, F.lit(False))
    sure = best.where(~unsure)
    back = sure.select("domain", F.col("left").alias("target"), F.col("target").alias("left"), F.col("best").alias("best_back"))
    mutual = sure.join(back, ["domain", "left", "target"]).where("left < target").withColumn("score", F.least("best", "best_back"))
    # Exact groups merge once at most, so their own representatives decide.
    sizes = exact.groupBy("domain", "exact_group").agg(F.count("*").alias("size"))
    many = p.select("domain", "event_id", "vector").join(exact.where("exact_size > 1"), ["domain", "event_id"]).withColumn("g", F.struct("domain", "exact_group"))
    reps = medoids(many, "g", "event_id", "vector").select("g.domain", "g.exact_group", F.col("event_id").alias("rep"))
    rep_of = st.write(sizes.join(reps, ["domain", "exact_group"], "left").select("domain", "exact_group", "size", F.coalesce("rep", "exact_group").alias("rep")))
    side = lambda c: rep_of.select("domain", F.col("exact_group").alias(f"{c}_group"), F.col("rep").alias(f"{c}_rep"), F.col("size").alias(f"{c}_size"))
    m = mutual.join(side("own"), ["domain", "own_group"]).join(side("target"), ["domain", "target_group"])
    full = p.select(*COMPARED, "vector")
    rr = m.join(full.alias("a"), (m["domain"] == F.col("a.domain")) & (m["own_rep"] == F.col("a.event_id"))).join(full.alias("b"), (m["domain"] == F.col("b.domain")) & (m["target_rep"] == F.col("b.event_id")))
    may = reason.isNull() & (V.cosine(F.col("a.vector"), F.col("b.vector")) >= need)
    fits = F.col("own_size") + F.col("target_size") <= MOST_MEMBERS
    cols = [m[c].alias(c) for c in ("domain", "left", "target", "score", "own_group", "target_group")]
    pairs = st.write(rr.select(*cols, fits.alias("fits"), F.coalesce(may, F.lit(False)).alias("may")).withColumn("turn", F.struct((-F.col("score")).alias("s"), "left", "target")))
    end = lambda c: F.to_json(F.struct("domain", F.col(c).alias("g")))
    open_pairs = pairs.where("fits AND may").select(end("own_group").alias("x"), end("target_group").alias("y"), "turn", "domain", "own_group", "target_group")
    merged = st.write(greedy_matching(st, open_pairs, "x", "y", "turn"))
    into = merged.select("domain", F.col("target_group").alias("exact_group"), F.col("own_group").alias("group_id"), "turn").unionByName(merged.select("domain", F.col("own_group").alias("exact_group"), F.col("own_group").alias("group_id"), "turn"))
    into = st.write(into)
    done = lambda c: into.select("domain", F.col("exact_group").alias(f"{c}_group"), F.col("group_id").alias(f"{c}_into"), F.col("turn").alias(f"{c}_turn"))
    late = pairs.join(done("own"), ["domain", "own_group"], "left").join(done("target"), ["domain", "target_group"], "left")
    before = lambda c: F.coalesce(F.col(f"{c}_turn") < F.col("turn"), F.lit(False))
    apart = ~F.coalesce(F.col("own_into") == F.col("target_into"), F.lit(False))
    crowded = late.where(apart & (before("own") | before("target")))
    oversized = late.where(apart & ~before("own") & ~before("target") & ~F.col("fits"))
    flag = lambda df, c, name: df.select("domain", F.col(c).alias("event_id"), F.lit(name).alias("flag"))
    flags = flag(best.where(unsure), "left", "ambiguous_fuzzy_candidates")
    for df, name in ((crowded, "ambiguous_fuzzy_candidates"), (oversized, "fuzzy_cluster_size_limit")):
        flags = flags.unionByName(flag(df, "left", name)).unionByName(flag(df, "target", name))
    member = exact.join(into.select("domain", "exact_group", "group_id", F.col("turn.s").alias("neg")), ["domain", "exact_group"], "left").join(best.select("domain", F.col("left").alias("event_id"), "runner_up"), ["domain", "event_id"], "left")
    rule = F.when(F.col("exact_size") > 1, "exact").when(F.col("neg").isNotNull(), "fuzzy").otherwise("singleton")
    score = F.when(F.col("exact_size") > 1, 1.0).otherwise(-F.col("neg"))
    members = st.write(member.select("domain", "event_id", F.coalesce("group_id", "exact_group").alias("group_id"), rule.alias("rule"), score.alias("score"), "runner_up"))
    size = members.groupBy("domain", "group_id").agg(F.count("*").alias("size"), F.min("event_id").alias("lone"))
    plural = members.join(size.where("size > 1"), ["domain", "group_id"]).join(p.select("domain", "event_id", "vector"), ["domain", "event_id"]).withColumn("g", F.struct("domain", "group_id"))
    rep = medoids(plural, "g", "event_id", "vector").select("g.domain", "g.group_id", F.col("event_id").alias("rep"))
    # A group has a few flags at most.
    flagged = flags.join(members.select("domain", "event_id", "group_id"), ["domain", "event_id"]).groupBy("domain", "group_id").agg(F.array_sort(F.collect_set("flag")).alias("flags"))
    groups = size.join(rep, ["domain", "group_id"], "left").join(flagged, ["domain", "group_id"], "left")
    groups = groups.select("domain", "group_id", F.coalesce("rep", "lone").alias("representative"), "size", F.coalesce("flags", F.array().cast("array<string>")).alias("flags"))
    return members, groups


def identities(members: DataFrame, previous: DataFrame, previous_sizes: DataFrame, build: str) -> tuple[DataFrame, DataFrame]:
    """members: domain, event_id, group_id. previous: domain, event_id, canonical_id. previous_sizes: domain,
    canonical_id, size.

    Only a group with one predecessor, which has no other successor, keeps its identity, and only if at least half of
    either side is common. Results: domain, group_id, canonical_id, state; and lineage: domain, predecessor, successor,
    relation_type, confidence."""
    size = members.groupBy("domain", "group_id").agg(F.count("*").alias("size"), F.sha2(F.array_join(F.array_sort(F.collect_list("event_id")), ","), 256).alias("key"))
    common = members.join(previous, ["domain", "event_id"]).groupBy("domain", "group_id", "canonical_id").agg(F.count("*").alias("common"))
    c = common.withColumns({"predecessors": F.count("*").over(Window.partitionBy("domain", "group_id")), "successors": F.count("*").over(Window.partitionBy("domain", "canonical_id"))})
    c = c.join(size.select("domain", "group_id", "size"), ["domain", "group_id"]).join(previous_sizes.select("domain", "canonical_id", F.col("size").alias("was")), ["domain", "canonical_id"], "left")
    keeps = (F.col("predecessors") == 1) & (F.col("successors") == 1) & (F.col("common") / F.col("size") >= 0.5) & (F.col("common") / F.greatest(F.coalesce("was", F.lit(0)), F.lit(1)) >= 0.5)
    c = c.withColumn("keeps", keeps)
    kept = c.where("keeps").select("domain", "group_id", F.col("canonical_id").alias("kept_id"))
    made = X.uuid5(NAMESPACE, F.concat_ws(":", "domain", F.lit(build), "key"))
    ids = size.join(kept, ["domain", "group_id"], "left").select("domain", "group_id", F.coalesce("kept_id", made).alias("canonical_id"), F.when(F.col("kept_id").isNotNull(), "retained").otherwise("new").alias("state"))
    kind = F.when(F.col("predecessors") > 1, "merge").when(F.col("successors") > 1, "split").otherwise("replaced")
    new = ids.where("state = 'new'").select("domain", "group_id", F.col("canonical_id").alias("successor"))
    lineage = c.where("NOT keeps").join(new, ["domain", "group_id"]).select("domain", F.col("canonical_id").alias("predecessor"), "successor", kind.alias("relation_type"), (F.col("common") / F.col("size")).alias("confidence"))
    return ids, lineage


def identity_status(ids: DataFrame, previous_ids: DataFrame, changed: DataFrame) -> DataFrame:
    """domain, canonical_id, status (active or retired) of what a build touches: new or changed identities become
    active, those that are gone retire."""
    now, old = ids.select("domain", "canonical_id").distinct(), previous_ids.select("domain", "canonical_id").distinct()
    fresh = now.join(old, ["domain", "canonical_id"], "left_anti").unionByName(now.join(changed.select("domain", "canonical_id"), ["domain", "canonical_id"], "left_semi")).distinct()
    gone = old.join(now, ["domain", "canonical_id"], "left_anti")
    return fresh.withColumn("status", F.lit("active")).unionByName(gone.withColumn("status", F.lit("retired")))
