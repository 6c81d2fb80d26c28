"""Aggregates of groups of records: centroids, medoids, labels, geometry, diverse choices."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import vectors as V

CARDS, PER_SOURCE, CANDIDATES = 10, 2, 200


def _units(df: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector has a direction, with it and its length as columns _u and _d."""
    known = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0))
    length = V.norm(F.col(vector))
    return known.where((length > 0) & (length < float("inf"))).withColumns({"_u": V.normalize(F.col(vector)), "_d": F.size(vector)})


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """The unit mean of unit vectors per group: group, centroid. A partial mean a group and task is all that is shuffled.

    Vectors that are null, zero or not finite take no part; of vectors of several lengths those of the most frequent
    length do, the longest among equals."""
    per = _units(df, vector).groupBy(group, "_d").agg(Summarizer.mean(array_to_vector("_u")).alias("m"), F.count("*").alias("n"))
    most = per.groupBy(group).agg(F.max_by("m", F.struct("n", "_d")).alias("m"))
    return most.select(group, V.normalize(vector_to_array("m")).alias("centroid"))


def medoids(df: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """The member closest to the centroid of its group; scores that agree to eight digits tie, for the smaller key. Members
    that take no part in the centroid are none."""
    c = centroids(df, group, vector)
    own = _units(df, vector).join(c, group).where(F.col("_d") == F.size("centroid"))
    scored = own.withColumn("score", F.round(V.cosine(F.col("_u"), F.col("centroid")), 8))
    return scored.groupBy(group).agg(F.min_by(key, F.struct((-F.col("score")).alias("s"), F.col(key).alias("k"))).alias(key), F.max("score").alias("score"))


def modal_labels(entities: DataFrame, records: DataFrame, group: str, kind: str = "event_type") -> DataFrame:
    """entities: group, key, name, n. The two most frequent entities and the most frequent type, as one label."""
    w = Window.partitionBy(group).orderBy(F.desc("n"), "key")
    top = entities.withColumn("r", F.row_number().over(w)).where("r <= 2")
    names = top.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda s: s["name"]).alias("names"))
    types = records.groupBy(group, kind).agg(F.count("*").alias("n"))
    best = types.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), F.asc_nulls_last(kind)))).where("r = 1")
    parts = F.array_compact(F.concat(F.coalesce("names", F.array().cast("array<string>")), F.array(F.coalesce(kind, F.lit("other")))))
    return best.join(names, group, "left").select(group, F.substring(F.array_join(parts, " · "), 1, 120).alias("label"))


def geometry(df: DataFrame, keys: Sequence[str], point: str | None = None) -> DataFrame:
    """Mean centre, greatest distance from it and number of the points x, y, z of each group; with ``point`` also the
    anchor, the point nearest the centre. Squares that agree to nine digits tie, for the smaller point."""
    m = df.groupBy(*keys).agg(*[F.avg(a).alias(f"c{a}") for a in "xyz"])
    away = F.sqrt(sum((F.pow(F.col(a) - F.col(f"c{a}"), 2) for a in "xyz"), F.lit(0.0)))
    anchor = [F.min_by(point, F.struct(F.round(away * away, 9).alias("s"), F.col(point).alias("p"))).alias("anchor")] if point else []
    return df.join(m, list(keys)).groupBy(*keys, "cx", "cy", "cz").agg(F.max(away).alias("radius"), F.count("*").alias("n"), *anchor)


def diverse_cards(df: DataFrame) -> DataFrame:
    """playlist_id, event_id, source, start_day -> the cards of each domain and their place.

    Greedy: always the newest event of the source used least so far, at most ``PER_SOURCE`` a source. With that cap the
    choice never looks beyond the newest ``PER_SOURCE`` of each of the first ``CARDS`` sources, so each domain reduces
    to that many rows before the greedy tail."""
    newest = Window.partitionBy("playlist_id", "source").orderBy(F.desc("start_day"), "event_id")
    two = df.withColumn("of_source", F.row_number().over(newest)).where(F.col("of_source") <= PER_SOURCE)
    lead = two.withColumn("round", F.row_number().over(Window.partitionBy("playlist_id", "of_source").orderBy(F.desc("start_day"), "event_id"))).where(F.col("round") <= CARDS)

    def choose(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["start_day", "event_id"], ascending=[False, True], kind="stable")
        used, out, rows = {}, [], f.to_dict("records")
        while rows and len(out) < CARDS:
            open_rows = [r for r in rows if used.get(r["source"], 0) < PER_SOURCE]
            if not open_rows:
                break
            best = min(open_rows, key=lambda r: (used.get(r["source"], 0), -r["start_day"], r["event_id"]))
            used[best["source"]] = used.get(best["source"], 0) + 1
            rows.remove(best)
            out.append((best["playlist_id"], best["event_id"], best["source"], len(out) + 1))
        return pd.DataFrame(out, columns=["playlist_id", "event_id", "source", "place"])

    return lead.groupBy("playlist_id").applyInPandas(choose, "playlist_id string, event_id string, source string, place int")
