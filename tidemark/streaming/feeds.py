"""Streams of records and counters: ingest, late weekly counts, usage, cursors, leases, schedules, pushes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.late_events import SCHEMA as VIEW
from tidemark.operators.late_events import LambdaView


def landing(spark: SparkSession, folder: str, schema: T.StructType | str, per_trigger: int = 1000) -> DataFrame:
    """Provider records as they land in a folder, with a stated schema."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(folder)


def insert_new(stream: DataFrame, target: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Appends records whose keys the target does not hold; one writer a target."""

    def write(batch: DataFrame, epoch: int) -> None:
        s = batch.sparkSession
        fresh = batch.dropDuplicates(keys)
        held = s._jvm.org.apache.hadoop.fs.Path(target)
        if held.getFileSystem(s._jsc.hadoopConfiguration()).exists(held):
            fresh = fresh.join(s.read.parquet(target).select(*keys), keys, "left_anti")
        fresh.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def served_view(spark: SparkSession, folder: str, view: LambdaView | None = None) -> DataFrame:
    """The newest complete version of a weekly view that lies in a folder, empty at first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    made = [f.getPath() for f in fs.listStatus(path)] if fs.exists(path) else []
    whole = sorted(str(p) for p in made if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))
    return spark.read.schema(VIEW).parquet(whole[-1]) if whole else (view or LambdaView()).empty(spark)


def weekly_fast_layer(log: DataFrame, folder: str, checkpoint: str, view: LambdaView | None = None) -> StreamingQuery:
    """The fast layer as a stream: each micro-batch of the log (src, rec_id, event_day, arrived_us) makes the next version
    of the view in ``folder``, which the batch layer replaces by a version of its own. The rule is that of the batch, by
    arrival, so a senseless event date moves nothing; a micro-batch that runs again overwrites its own version."""
    view = view or LambdaView()

    def write(batch: DataFrame, epoch: int) -> None:
        made = view.fast_increment(served_view(batch.sparkSession, folder, view), batch)
        made.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{epoch:012d}")

    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage_counters(calls: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Daily counts per service and operation from a stream of calls (ts, service, operation, tokens, ok)."""
    day = F.window("ts", "1 day").alias("day")
    return calls.withWatermark("ts", lateness).groupBy(day, "service", "operation").agg(F.count("*").alias("calls"), F.count_if(F.col("ok")).alias("succeeded"), F.sum("tokens").alias("tokens"), F.max("ts").alias("last_called_at"))


def newest_per_day(snapshots: DataFrame, columns: list[str]) -> DataFrame:
    """The newest resource snapshot of each day, in update mode."""
    day = F.window("ts", "1 day").alias("day")
    return snapshots.groupBy(day).agg(F.max_by(F.struct(*columns), "ts").alias("newest"))


def cursors(moves: DataFrame, key: str = "domain", at: str = "ts") -> DataFrame:
    """The last move of each cursor; an older move that comes later changes nothing."""
    return moves.groupBy(key).agg(F.max_by("position", F.struct(at, "position")).alias("position"), F.max(at).alias("moved_at"))


def expired_leases(jobs: DataFrame, heartbeats: DataFrame, now: Column, lease_s: int = 900, stale_s: int = 120) -> DataFrame:
    """Running jobs to queue again: their lease ran out, or their worker has not been heard of. jobs: id, worker,
    started_at. heartbeats: worker, updated_at."""
    before = lambda s: now - F.expr(f"INTERVAL {s} SECONDS")
    alive = heartbeats.where(F.col("updated_at") >= before(stale_s)).select("worker").distinct()
    over = jobs.where(F.col("started_at") < before(lease_s)).withColumn("reason", F.lit("lease"))
    lost = jobs.where(F.col("started_at") >= before(lease_s)).join(alive, "worker", "left_anti").withColumn("reason", F.lit("worker"))
    return over.unionByName(lost.select(over.columns))


def due(sources: DataFrame, now: Column, minutes: int, jitter: int) -> DataFrame:
    """Sources whose sync is due: never synced, or longer ago than the interval and a jitter fixed by their id."""
    from tidemark.functions.times import hash_jitter

    wait = F.lit(minutes) + hash_jitter(F.concat_ws(":", "id", F.col("last_sync").cast("string")), jitter)
    return sources.where(F.col("last_sync").isNull() | ((now.cast("timestamp").cast("long") - F.col("last_sync").cast("timestamp").cast("long")) >= wait * 60))


def refresh_schedule(periods: DataFrame, now: Column, cooldown_minutes: int, hour: int, minute: int, zone: str) -> DataFrame:
    """When each period (period_start, last_ready_at) is refreshed: the running one after a cooldown, others in the
    daily batch."""
    from tidemark.functions import times as D

    running = F.col("period_start") == D.period_start(D.local_date(now, zone), "day")
    at = F.when(running, D.cooldown(now, F.col("last_ready_at"), cooldown_minutes)).otherwise(D.next_daily_run(now, hour, minute, zone))
    return periods.select("*", at.alias("scheduled_for"), F.when(running, "latest_cooldown").otherwise("historical_batch").alias("mode"))


def push(stream: DataFrame, send: Callable[[list], None], every: str, checkpoint: str, most: int = 200) -> StreamingQuery:
    """Sends the first rows of each micro-batch, such as a job list, to subscribers."""
    return stream.writeStream.foreachBatch(lambda b, _: send([r.asDict() for r in b.limit(most).collect()])).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
