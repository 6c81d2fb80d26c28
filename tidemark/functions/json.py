"""Model answers and other JSON as typed columns, with what is wrong as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import vectors as V

EVENT = "struct<title:string,summary:string,event_type:string,direction:string,confidence:string,source_ids:array<string>,entities:array<struct<entity_type:string,name:string,key:string,role:string,confidence:string>>,relations:array<struct<relation_type:string,source_entity_key:string,target_entity_key:string,confidence:string>>>"
ENVELOPE = f"struct<videos:array<struct<video_id:string,events:array<{EVENT}>>>>"


def parse_answers(df: DataFrame, key: str, answer: str, expected: Column) -> tuple[DataFrame, DataFrame]:
    """Events of extraction answers, and warnings and errors.

    expected: the list of record ids that an answer must hold. A broken envelope, a missing, unknown or repeated
    record id is an error of the answer, which keeps its valid rows; an event without a title is dropped with a
    warning; an empty list of events is valid; a null answer is a broken envelope."""
    body = F.from_json(X.strip_wrappers(answer), ENVELOPE)
    p = df.select(F.col(key).alias("answer_id"), body.alias("b"), expected.alias("expected"))
    ids = F.coalesce(F.transform("b.videos", lambda v: v["video_id"]), F.array().cast("array<string>"))
    want = F.coalesce("expected", F.array().cast("array<string>"))
    problems = F.concat(
        F.when(F.col("b.videos").isNull(), F.array(F.lit("no_envelope"))).otherwise(F.array().cast("array<string>")),
        F.transform(F.array_except(want, ids), lambda i: F.concat(F.lit("missing:"), i)),
        F.when(F.size(want) > 0, F.transform(F.array_except(ids, want), lambda i: F.concat(F.lit("unknown:"), F.coalesce(i, F.lit(""))))).otherwise(F.array().cast("array<string>")),
        F.when(F.size(ids) > F.size(F.array_distinct(ids)), F.array(F.lit("repeated_id"))).otherwise(F.array().cast("array<string>")),
    )
    errors = p.select("answer_id", F.explode(problems).alias("problem")).withColumn("level", F.lit("error"))
    usable = F.filter("b.videos", lambda v: v["video_id"].isNotNull() & ((F.size(want) == 0) | F.array_contains(want, v["video_id"])))
    rows = p.select("answer_id", F.posexplode(usable).alias("v_no", "v")).select("answer_id", F.col("v.video_id").alias("video_id"), F.posexplode("v.events").alias("event_no", "e"))
    named = F.length(F.trim(F.coalesce("e.title", F.lit("")))) > 0
    warnings = rows.where(~named).select("answer_id", F.concat(F.lit("no_title:"), "video_id", F.lit("/"), F.col("event_no").cast("string")).alias("problem"), F.lit("warning").alias("level"))
    events = rows.where(named).select(
        "answer_id", "video_id", "event_no", X.short_text(F.col("e.title"), 300).alias("title"), X.short_text(F.col("e.summary"), 600).alias("summary"),
        F.coalesce(F.nullif(X.snake(F.col("e.event_type")), F.lit("")), F.lit("other")).alias("event_type"), F.coalesce("e.direction", F.lit("unknown")).alias("direction"),
        V.clamp_confidence(F.col("e.confidence")).alias("confidence"), "e.source_ids", "e.entities", "e.relations",
    )
    return events, errors.unionByName(warnings)


def endpoint_warnings(entities: Column, relations: Column) -> Column:
    """What is wrong with the ends of relations: missing, unmatched, or matched by several entities."""
    keys = F.transform(entities, lambda e: e["key"])

    def of(end: str):
        def one(r: Column) -> Column:
            k = r[end]
            hits = F.size(F.filter(keys, lambda x: x == k))
            return F.when(k.isNull() | (k == ""), f"missing:{end}").when(hits == 0, F.concat(F.lit(f"unmatched:{end}:"), k)).when(hits > 1, F.concat(F.lit(f"ambiguous:{end}:"), k))

        return one

    return F.array_compact(F.concat(F.transform(relations, of("source_entity_key")), F.transform(relations, of("target_entity_key"))))


def provenance(events: DataFrame, sources: DataFrame, most: int = 12) -> tuple[DataFrame, DataFrame]:
    """Rows of evidence from the distinct first source ids of events, and the ids that no source has."""
    ids = events.select("video_id", "event_no", F.posexplode(F.slice(F.array_distinct("source_ids"), 1, most)).alias("place", "source_id"))
    j = ids.join(sources.select("video_id", "source_id", "quoted"), ["video_id", "source_id"], "left")
    return j.where("quoted IS NOT NULL"), j.where("quoted IS NULL").select("video_id", "event_no", "source_id")


def stable_hash(*columns: Column) -> Column:
    """SHA-256 over JSON with sorted names and explicit nulls."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def event_key(title: Column, event_type: Column, start: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", X.normalized_key(title), F.coalesce(event_type, F.lit("other")), F.coalesce(start.cast("string"), F.lit(""))), 256), 1, 24)


def embedding_text(title: Column, summary: Column, event_type: Column, names: Column) -> Column:
    """The document of an event that is embedded: one labelled line each, empty ones left out."""
    line = lambda k, v: F.when(F.length(v) > 0, F.concat(F.lit(k + ": "), v))
    return F.concat_ws("\n", line("title", title), line("summary", summary), line("type", event_type), line("entities", F.array_join(F.array_sort(F.array_distinct(names)), ", ")))


def merge_usage(usages: Column) -> Column:
    """One usage from many: counts add, missing ones count as zero, a missing total is the sum of its parts."""
    zero = F.struct(F.lit(0).cast("bigint").alias("calls"), F.lit(0).cast("bigint").alias("input"), F.lit(0).cast("bigint").alias("output"), F.lit(0).cast("bigint").alias("total"))

    def add(a: Column, u: Column) -> Column:
        n = lambda c: F.coalesce(u[c].cast("bigint"), F.lit(0))
        total = F.when(n("total") > 0, n("total")).otherwise(n("input") + n("output"))
        return F.struct((a["calls"] + n("calls")).alias("calls"), (a["input"] + n("input")).alias("input"), (a["output"] + n("output")).alias("output"), (a["total"] + total).alias("total"))

    return F.aggregate(usages, zero, add)
