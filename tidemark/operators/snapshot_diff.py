"""What changed between full snapshots: full outer join on the primary key over hashes of canonical rows.

Cases: null is a value of its own in every compared column; exact duplicates count once; a snapshot without rows is
an empty table, so everything in its parent is removed, and the other way round; null or blank keys make no row;
a parent that is not a row of the snapshot table is not compared; columns outside ``compared`` never matter.
A hot snapshot is split by adaptive skew joins in the step that attaches rows to pairs; the outer join itself is on
(snapshot, key), of which no value holds more than the copies of one key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import norm_id


def row_hash(columns: Sequence[str]) -> Column:
    """128 bits over an unambiguous encoding: names, types' JSON forms and nulls all count."""
    return F.unhex(F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary")))


def diff(pairs: DataFrame, rows: DataFrame, compared: Sequence[str]) -> DataFrame:
    """pairs: child, parent. rows: snapshot, key and the compared columns. Result: child, key, change_kind."""
    hashed = rows.where("snapshot IS NOT NULL AND key IS NOT NULL").select("snapshot", "key", row_hash(compared).alias("h")).distinct()
    side = lambda own, h: pairs.select("child", F.col(own).alias("snapshot")).join(hashed, "snapshot").select("child", "key", F.col("h").alias(h))
    new, old = side("child", "new_h"), side("parent", "old_h")
    kind = F.when(F.col("old_h").isNull(), "added").when(F.col("new_h").isNull(), "removed").otherwise("changed")
    return new.join(old, ["child", "key"], "full").where(~F.col("new_h").eqNullSafe(F.col("old_h"))).select("child", "key", kind.alias("change_kind"))


def snapshot_pairs(snapshots: DataFrame, statuses: Sequence[str] = ("ready",)) -> DataFrame:
    """(child, parent) of the snapshots in ``statuses`` whose parent exists, whatever the parent's status."""
    s = snapshots.select(norm_id("id").alias("child"), norm_id("parent_snapshot_id").alias("parent"), "status")
    child = s.where(F.col("status").isin(*statuses) & F.col("child").isNotNull()).select("child", "parent").distinct()
    return child.join(s.select(F.col("child").alias("parent")).where("parent IS NOT NULL"), "parent", "left_semi").select("child", "parent")
