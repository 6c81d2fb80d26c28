"""References to records that do not exist, by runs of integer parent keys and an as-of match.

A key reads as an integer behind a prefix (``integer_keys``): digits are their number, and an id that ends in twelve
hexadecimal digits, such as a UUID or a pair of them, is the number these make behind the rest of it; any other text is a
prefix of its own. Integers lie in blocks of ``BLOCK``. Sorted parent integers compress into contiguous runs
[start, end] of a block (``key_runs``), from the parents alone; a reference takes the run of its block whose start
precedes it (``match_runs``), and one beyond that run's end is an orphan. Numbered keys make a run a block, so a billion
of them are some fifteen thousand rows; random ids make a run each, and then runs save nothing (README).

References are reduced to distinct keys before any sort, so a key that holds a third of all references is one row
there, and so is a parent that was delivered as often; only keys with a complaint go back to the referring rows.

Cases: null or blank references are not references; spelling (case, outer blanks) of keys does not matter; parents
that occur repeatedly count once, with their earliest arrival; a reference without arrival time is never ``later``;
an empty parent table makes every reference ``missing``; a referring row that was delivered repeatedly comes out once, with its earliest arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Integers of a block, so that a task sorts no more of them together.
BLOCK = 65_536
PLACE = ["kind", "prefix", "block"]


def integer_keys(keys: DataFrame) -> DataFrame:
    """Adds prefix, block and ik to rows with columns kind, key; different keys have different (prefix, ik)."""
    number, tail = r"^(?:0|[1-9][0-9]{0,17})$", r"^(?s)(.*?)([0-9a-f]{12})$"
    digits, hexadecimal = F.col("key").rlike(number), F.col("key").rlike(tail)
    prefix = F.when(digits, "d").when(hexadecimal, F.concat(F.lit("x"), F.regexp_extract("key", tail, 1))).otherwise(F.concat(F.lit("t"), F.col("key")))
    ik = F.when(digits, F.col("key").try_cast("long")).when(hexadecimal, F.conv(F.regexp_extract("key", tail, 2), 16, 10).cast("long")).otherwise(F.lit(0).cast("long"))
    return keys.withColumns({"prefix": prefix, "ik": ik}).withColumn("block", F.floor(F.col("ik") / F.lit(BLOCK)))


def key_runs(parents: DataFrame) -> DataFrame:
    """Contiguous runs of the distinct integers in ``parents`` (kind, prefix, block, ik): run_start, run_end."""
    island = F.col("ik") - F.row_number().over(Window.partitionBy(*PLACE).orderBy("ik"))
    runs = parents.select(*PLACE, "ik", island.alias("island"))
    return runs.groupBy(*PLACE, "island").agg(F.min("ik").alias("run_start"), F.max("ik").alias("run_end")).drop("island")


def match_runs(asked: DataFrame, runs: DataFrame) -> DataFrame:
    """asked: kind, key, prefix, block, ik. Adds run_start and run_end of the last run that starts at or before ik, null
    where none does."""
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    starts = runs.select(*PLACE, F.col("run_start").alias("ik"), none("key", "string"), F.struct("run_start", "run_end").alias("run"))
    both = starts.unionByName(asked.select(*PLACE, "ik", "key", none("run", "struct<run_start:long,run_end:long>")))
    w = Window.partitionBy(*PLACE).orderBy("ik", F.desc_nulls_last("run")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    matched = both.withColumn("last", F.last("run", ignorenulls=True).over(w)).where("key IS NOT NULL")
    return matched.select(*PLACE, "key", "ik", F.col("last.run_start").alias("run_start"), F.col("last.run_end").alias("run_end"))


def find_orphans(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """refs: src, rec_id, kind, key, made_us. parents: kind, key, gone BOOLEAN, came_us.

    Result: src, rec_id, made_us, ref_state in missing, deleted, later."""
    refs = refs.where("key IS NOT NULL")
    asked = refs.groupBy("kind", "key").agg(F.min("made_us").alias("first_us"))
    held = parents.where("key IS NOT NULL").groupBy("kind", "key").agg(F.max("gone").alias("gone"), F.min("came_us").alias("came_us"))
    matched = match_runs(integer_keys(asked), key_runs(integer_keys(held)))
    lone = matched.where(F.col("run_end").isNull() | (F.col("ik") > F.col("run_end"))).select("kind", "key", F.lit("missing").alias("ref_state"), F.lit(None).cast("long").alias("came_us"))
    # What is there may be deleted, or have come after the first reference to it.
    state = F.when(F.col("gone"), "deleted").when(F.col("came_us") > F.col("first_us"), "later")
    bad = lone.unionByName(asked.join(held, ["kind", "key"]).select("kind", "key", state.alias("ref_state"), "came_us").where("ref_state IS NOT NULL"))
    hit = refs.join(bad, ["kind", "key"]).groupBy("src", "rec_id", "kind", "key", "ref_state", "came_us").agg(F.min("made_us").alias("made_us"))
    return hit.where("ref_state <> 'later' OR came_us > made_us").select("src", "rec_id", "made_us", "ref_state")
