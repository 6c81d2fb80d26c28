"""Period aggregates by event time that late records correct until a cut-off: lambda views.

A view has a row for each source and period: provisional (in time), corrections (late, before the cut-off), dropped (from
the cut-off on), final (what stands) and state, ``open`` or ``frozen``. Three steps make it:

* the fast layer adds a micro-batch to the rows of its periods (``fast_increment``); cheap, and approximate in that a
  repeated delivery counts again; a frozen period takes nothing but ``dropped``;
* the scheduled batch recomputes every open period from the whole log and replaces it (``batch_recompute``);
* a batch whose clock is ``lateness_days`` past a period's end freezes it; from then on its counts stand, and what
  arrives is dropped, and counted as that.

``replay`` runs them over a log as they would have run: per run of the schedule the fast layer takes what arrived since
the last run, arrivals are judged against the view that is served, then the batch replaces it.

Records that share an id are one record, whose earliest arrival counts. Cases: a null id, event time or arrival
makes no record; ties of arrival at the boundary of a period or of the cut-off fall to the later class; an empty log
gives empty views; extra columns of the log are not read. No step gathers a period into one task: all counts are
partial aggregates, so a period with a third of all rows is as cheap as any. A view has a row a source and period,
whatever the number of records.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import Stages, small
from tidemark.sources.tables import DAY_US

ON_TIME, CORRECTS, DROPPED = "on_time", "corrects", "dropped"


def monday(day: Column) -> Column:
    """The day number of the Monday on or before ``day``; 1970-01-01 was a Thursday."""
    return (day - F.pmod(day + F.lit(3), F.lit(7))).cast("int")


COUNTS = ["provisional", "corrections", "dropped", "final"]
SCHEMA = "src string, week_day int, provisional long, corrections long, dropped long, final long, state string"
OPEN, FROZEN = "open", "frozen"
#: Rows of a view up to which it is sent to every task: a row a source and week, so 100,000 are 19 centuries of a source.
VIEW_ROWS = 100_000


@dataclass(frozen=True)
class LambdaView:
    """A weekly view of a log with columns src, rec_id, event_day INT, arrived_us BIGINT."""

    lateness_days: int = 14
    period_days: int = 7

    def empty(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([], SCHEMA)

    def records(self, log: DataFrame) -> DataFrame:
        """One row a record: src, rec_id, week_day, arrived_us."""
        ok = log.where("rec_id IS NOT NULL AND event_day IS NOT NULL AND arrived_us IS NOT NULL")
        one = ok.groupBy("src", "rec_id").agg(F.min("arrived_us").alias("arrived_us"), F.min("event_day").alias("event_day"))
        return one.select("src", "rec_id", monday(F.col("event_day")).alias("week_day"), "arrived_us")

    def _end_us(self) -> Column:
        return (F.col("week_day") + F.lit(self.period_days)).cast("long") * DAY_US

    def outcome(self) -> Column:
        """What an arrival is to its period."""
        late = F.col("arrived_us") < self._end_us() + F.lit(self.lateness_days * DAY_US)
        return F.when(F.col("arrived_us") < self._end_us(), ON_TIME).when(late, CORRECTS).otherwise(DROPPED)

    def counts(self, records: DataFrame) -> DataFrame:
        """Per source and week: what came in time, what corrected, what was dropped, and the count that stands."""
        n = lambda *k: F.count_if(F.col("outcome").isin(*k))
        return records.withColumn("outcome", self.outcome()).groupBy("src", "week_day").agg(
            n(ON_TIME).alias("provisional"), n(CORRECTS).alias("corrections"), n(DROPPED).alias("dropped"), n(ON_TIME, CORRECTS).alias("final")
        )

    def fast_increment(self, view: DataFrame, batch: DataFrame) -> DataFrame:
        """The view after a micro-batch of the log."""
        fresh = self.counts(self.records(batch)).withColumn("state", F.lit(OPEN))
        held = lambda c: F.sum(F.when(F.col("old"), F.col(c)).otherwise(0))
        came = lambda c: F.sum(F.when(~F.col("old"), F.col(c)).otherwise(0))
        both = view.withColumn("old", F.lit(True)).unionByName(fresh.withColumn("old", F.lit(False))).groupBy("src", "week_day")
        sums = both.agg(F.bool_or(F.col("state") == FROZEN).alias("shut"), *[held(c).alias(c) for c in COUNTS], *[came(c).alias(f"new_{c}") for c in COUNTS])
        plus = lambda c: (F.col(c) + F.when(F.col("shut"), 0).otherwise(F.col(f"new_{c}"))).alias(c)
        dropped = F.col("dropped") + F.col("new_dropped") + F.when(F.col("shut"), F.col("new_final")).otherwise(0)
        return sums.select("src", "week_day", plus("provisional"), plus("corrections"), dropped.alias("dropped"), plus("final"), F.when(F.col("shut"), FROZEN).otherwise(OPEN).alias("state"))

    def batch_recompute(self, log: DataFrame, view: DataFrame, as_of_us: int) -> DataFrame:
        """The view after a scheduled batch: open periods anew from the whole log, frozen ones as they stand in ``view``
        but for what was dropped since. A period that froze before a batch ever saw it is computed once."""
        return self._rebuild(self.records(log.where(F.col("arrived_us") <= F.lit(as_of_us))), view, as_of_us)

    def _rebuild(self, records: DataFrame, view: DataFrame, as_of_us: int) -> DataFrame:
        made = self.counts(records)
        stood = view.where(F.col("state") == FROZEN).select("src", "week_day", *[F.col(c).alias(f"old_{c}") for c in COUNTS])
        both = made.join(stood, ["src", "week_day"], "full")
        shut = F.col("old_final").isNotNull()
        keep = lambda c: F.when(shut, F.col(f"old_{c}")).otherwise(F.col(c)).alias(c)
        # What the log holds beyond a frozen count was dropped.
        dropped = F.when(shut & F.col("final").isNotNull(), F.col("final") + F.col("dropped") - F.col("old_final")).when(shut, F.col("old_dropped")).otherwise(F.col("dropped"))
        due = self._end_us() + F.lit(self.lateness_days * DAY_US) <= F.lit(as_of_us)
        return both.select("src", "week_day", keep("provisional"), keep("corrections"), dropped.alias("dropped"), keep("final"), F.when(shut | due, FROZEN).otherwise(OPEN).alias("state"))

    def judged(self, records: DataFrame, view: DataFrame) -> DataFrame:
        """Arrivals against the view that is served: src, rec_id, week_day, outcome. A frozen period drops them all."""
        shut = view.where(F.col("state") == FROZEN).select("src", "week_day", F.lit(True).alias("shut"))
        known = records.join(small(shut, VIEW_ROWS), ["src", "week_day"], "left")
        return known.select("src", "rec_id", "week_day", F.when(F.col("shut"), DROPPED).otherwise(self.outcome()).alias("outcome"))

    def schedule(self, records: DataFrame, runs: int) -> list[int]:
        """The clocks of at most ``runs`` batches, on Mondays 00:00 UTC, the last at or after the last arrival."""
        first, last = records.agg(F.min("arrived_us"), F.max("arrived_us")).first()
        if first is None:
            return []
        week, shift = self.period_days * DAY_US, 4 * DAY_US
        ceil = lambda us: -((shift - us) // week) * week + shift
        return sorted({ceil(first + (last - first) * (i + 1) // runs) for i in range(runs)})

    def replay(self, log: DataFrame, runs: int = 4) -> tuple[DataFrame, DataFrame]:
        """The view after a schedule of batches over the log, and every record's outcome as judged on arrival: src,
        rec_id, week_day, outcome. The number of runs changes neither."""
        spark = log.sparkSession
        st = Stages(spark, "lambda")
        records = st.write(self.records(log))
        view, parts, before = self.empty(spark), [], None
        for now in self.schedule(records, runs):
            since = F.lit(True) if before is None else F.col("arrived_us") > F.lit(before)
            fresh = since & (F.col("arrived_us") <= F.lit(now))
            parts.append(self.judged(records.where(fresh), view))
            served = self.fast_increment(view, log.where(fresh))
            view, before = st.write(self._rebuild(records.where(F.col("arrived_us") <= F.lit(now)), served, now)), now
        none = self.judged(records.limit(0), view)
        return view, reduce(DataFrame.unionByName, parts) if parts else none


def found(view: LambdaView, log: DataFrame) -> DataFrame:
    """The late records: src, rec_id, week_day, outcome ``corrects`` or ``dropped``."""
    return view.replay(log)[1].where(F.col("outcome") != ON_TIME)
