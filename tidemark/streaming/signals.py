"""Change signals to builds: dirty generations, debounce, coalescing, duplicates and late builds.

Streams carry event time; the watermark is the longest wait, and a signal behind it counts for the next generation.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUIET_S, LONGEST_S, REASONS = 120, 900, 8
STATE = "generation long, first_us long, last_us long, reasons array<string>"
FIRED = "domain string, generation long, fire_at timestamp, signals long, reasons array<string>"


def fire_at_us(first_us: int, last_us: int) -> int:
    """When a build may start: after a quiet time, but not later than the longest wait after the first signal."""
    return min(last_us + QUIET_S * 1_000_000, first_us + LONGEST_S * 1_000_000)


def fold_signals(generation: int, first: int | None, last: int | None, reasons: list[str], signals: Iterable[tuple[int, str]]) -> tuple[list[tuple], tuple]:
    """Builds that the signals (time in microseconds, reason; in order) let fire before later ones, and the new state."""
    fired = []
    for at, why in signals:
        if first is not None and at > fire_at_us(first, last):
            fired.append((generation, fire_at_us(first, last), list(reasons)))
            first, reasons = None, []
        generation += 1
        first, last = (at, at) if first is None else (min(first, at), max(last, at))
        reasons = [*reasons, why][-REASONS:]
    return fired, (generation, first, last, reasons)


def debounced(signals: DataFrame) -> DataFrame:
    """signals: domain, ts, reason as a stream. A row for each build that is due, with the generation it must reach."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        generation, first, last, reasons = state.get if state.exists else (0, None, None, [])
        out = []
        if state.hasTimedOut:
            if first is not None:
                out.append((generation, fire_at_us(first, last), list(reasons)))
            state.update((generation, None, None, []))
        else:
            rows = [(int(t.value // 1000), r or "") for f in frames for t, r in zip(f["ts"], f["reason"])]
            fired, (generation, first, last, reasons) = fold_signals(generation, first, last, list(reasons or []), sorted(rows))
            out += fired
            state.update((generation, first, last, reasons))
            if first is not None:
                due = fire_at_us(first, last) // 1000
                state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], g, pd.Timestamp(at, unit="us"), g, r) for g, at, r in out], columns=["domain", "generation", "fire_at", "signals", "reasons"])

    return (
        signals.withWatermark("ts", f"{LONGEST_S} seconds")
        .groupBy("domain")
        .applyInPandasWithState(step, FIRED, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )


#: Width of the blocks of time in which bursts are sought, in seconds.
BLOCK_S = 86_400


def sessions(signals: DataFrame, key: str, at: str) -> DataFrame:
    """The batch form of ``debounced``: ``key``, first_us, last_us, signals, fire_us for signals with a time in microseconds
    in column ``at``; rows with a null key or time are no signals.

    A gap longer than the quiet time ends a burst whatever came before, so bursts are found within blocks of time, and
    what a block hands to the next is one row a block. A burst no longer than the longest wait is one session; a longer
    one is cut in its order, burst by burst, with memory of one batch of rows."""
    quiet, longest = QUIET_S * 1_000_000, LONGEST_S * 1_000_000
    e = signals.select(F.col(key).alias("k"), F.col(at).alias("t")).dropna().withColumn("block", F.floor(F.col("t") / (BLOCK_S * 1_000_000)))
    spans = e.groupBy("k", "block").agg(F.max("t").alias("block_last"))
    before = F.lag("block_last").over(Window.partitionBy("k").orderBy("block"))
    inside = Window.partitionBy("k", "block").orderBy("t")
    gaps = e.join(spans.select("k", "block", before.alias("earlier")), ["k", "block"]).withColumn("prev", F.coalesce(F.lag("t").over(inside), "earlier"))
    begins = gaps.withColumn("begin", F.when(F.col("prev").isNull() | (F.col("t") - F.col("prev") > quiet), F.col("t")))
    started = begins.withColumn("begin", F.last("begin", ignorenulls=True).over(inside))
    carried = started.groupBy("k", "block").agg(F.max("begin").alias("newest"))
    hold = F.last("newest", ignorenulls=True).over(Window.partitionBy("k").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    burst = started.join(carried.select("k", "block", hold.alias("held")), ["k", "block"]).select("k", F.coalesce("begin", "held").alias("burst"), "t")
    ends = burst.groupBy("k", "burst").agg(F.max("t").alias("end"), F.count("*").alias("n"))
    short = ends.where(F.col("end") - F.col("burst") <= longest).select("k", F.col("burst").alias("first_us"), F.col("end").alias("last_us"), F.col("n").alias("signals"))
    long = ends.where(F.col("end") - F.col("burst") > longest).select("k", "burst")

    def cut(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, open_ = None, None
        for f in batches:
            done = []
            for k, b, t in zip(f["k"], f["burst"], f["t"]):
                if now != (k, b) or t > open_[0] + longest:
                    if open_:
                        done.append((now[0], *open_))
                    now, open_ = (k, b), [t, t, 0]
                open_[1], open_[2] = t, open_[2] + 1
            yield pd.DataFrame(done, columns=["k", "first_us", "last_us", "signals"])
        if open_:
            yield pd.DataFrame([(now[0], *open_)], columns=["k", "first_us", "last_us", "signals"])

    ordered = burst.join(long, ["k", "burst"]).repartition("k", "burst").sortWithinPartitions("k", "burst", "t")
    parts = ordered.mapInPandas(cut, f"k {e.schema['k'].dataType.simpleString()}, first_us long, last_us long, signals long")
    fire = F.least(F.col("last_us") + quiet, F.col("first_us") + longest).alias("fire_us")
    return short.unionByName(parts).select(F.col("k").alias(key), "first_us", "last_us", "signals", fire)


def dirty_generations(signals: DataFrame) -> DataFrame:
    """How many signals each domain has had, its first and its last: a running count in update mode."""
    return signals.groupBy("domain").agg(F.count("*").alias("generation"), F.min("ts").alias("first_dirty_at"), F.max("ts").alias("last_dirty_at"))


def without_repeats(jobs: DataFrame, key: str = "dedupe_key", within: str = "1 hour") -> DataFrame:
    """A stream of jobs without those whose key came before within the time."""
    return jobs.withWatermark("ts", within).dropDuplicatesWithinWatermark([key])


def needs_build(due: DataFrame, built: DataFrame) -> DataFrame:
    """Builds that are due: skipped where the generation is already built, with ``follow_up`` where a newer one waits.

    due: domain, generation, wanted. built: domain, built_generation."""
    j = due.join(built, "domain", "left")
    done = F.coalesce(F.col("built_generation"), F.lit(0))
    return j.where(F.col("generation") > done).select("domain", "generation", (F.col("wanted") > F.col("generation")).alias("follow_up"))
