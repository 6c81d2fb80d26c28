"""Keyed state machines: a circuit breaker, and a daily budget read from a cumulative meter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Seconds in which failures count, how many of how many jobs open the circuit, how long it then stays open
# the first, second and every later time in a row, and how long a probe may be out.
WINDOW_S, FAILURES, JOBS = 600, 4, 2
PAUSES_S, PROBE_S = (300, 900, 1800), 900
CLOSED = {"state": "closed", "failures": [], "turn": 0, "opened": 0.0, "probe": "", "probe_at": 0.0}


def claim(state: dict, at: float, job: str) -> tuple[bool, dict]:
    """Whether a job may start at a time in seconds, and the circuit after that. Behind its pause an open circuit lets
    one probe pass; a probe without an outcome within ``PROBE_S`` is replaced by the next job."""
    if state["state"] == "closed":
        return True, state
    waited = at - state["opened"] >= PAUSES_S[state["turn"]] if state["state"] == "open" else at - state["probe_at"] >= PROBE_S
    return waited, {**state, "state": "half_open", "probe": job, "probe_at": at} if waited else state


def failed(state: dict, at: float, job: str) -> dict:
    """The circuit after a failure: four of two jobs within ten minutes open it, a probe's failure opens it for longer."""
    if state["state"] == "open":
        return state
    if state["state"] == "half_open":
        longer = min(state["turn"] + 1, len(PAUSES_S) - 1)
        return {**state, "state": "open", "turn": longer, "opened": at, "probe": "", "probe_at": 0.0} if job == state["probe"] else state
    seen = [f for f in state["failures"] if f[0] >= at - WINDOW_S] + [[at, job]]
    full = len(seen) >= FAILURES and len({f[1] for f in seen}) >= JOBS
    return {**state, "failures": seen} | ({"state": "open", "turn": 0, "opened": at} if full else {})


def breaker_step(state: dict, at: float, job: str, ok: bool) -> dict:
    """The circuit after an attempt: a claim and its outcome. Any success closes it and forgets all failures."""
    return dict(CLOSED) if ok else failed(claim(state, at, job)[1], at, job)


def may_pass(state: dict, at: float) -> bool:
    return claim(state, at, "")[0]


def circuit_states(attempts: DataFrame) -> DataFrame:
    """attempts: service, n (order within a service), at (seconds), job, ok. The state after each: service, n, state.

    A success forgets everything, so the failures between two successes of a service are a run of their own, and only
    runs with enough failures to open the circuit reach Python. Runs are numbered by counts over blocks of ``at`` and
    within them, so that no task needs all of a service; a run itself is in one task. Null jobs are one job."""
    a = attempts.select("service", "n", "at", F.coalesce("job", F.lit("")).alias("job"), F.coalesce("ok", F.lit(False)).alias("ok")).withColumn("block", F.floor(F.col("n") / F.lit(10_000)))
    order = Window.partitionBy("service", "block").orderBy("n")
    inside = a.withColumn("run", F.count_if("ok").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    per = a.groupBy("service", "block").agg(F.count_if("ok").alias("oks"))
    before = F.coalesce(F.sum("oks").over(Window.partitionBy("service").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = inside.join(per.select("service", "block", before.alias("before")), ["service", "block"]).withColumn("run", F.col("run") + F.col("before"))
    sized = runs.withColumn("bad", F.count_if(~F.col("ok")).over(Window.partitionBy("service", "run"))).select("service", "run", "n", "at", "job", "ok", "bad")
    kind = attempts.schema

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("n", kind="stable", ignore_index=True)
        state, out = dict(CLOSED), []
        for at, job, ok in zip(f["at"], f["job"], f["ok"]):
            state = breaker_step(state, at, job, bool(ok))
            out.append(state["state"])
        return f[["service", "n"]].assign(state=out)

    shape = f"service {kind['service'].dataType.simpleString()}, n {kind['n'].dataType.simpleString()}, state string"
    risky = sized.where(F.col("bad") >= FAILURES).groupBy("service", "run").applyInPandas(fold, shape)
    return risky.unionByName(sized.where(F.col("bad") < FAILURES).select("service", "n", F.lit("closed").alias("state")))


# Fixed value: the share of a window that is its end.
WHOLE = 100.0
EMPTY_METER = {"day": "", "window": "", "reading": None, "spent": 0.0, "uncertain": ""}


def meter_step(state: dict, day: str, window: str, reading: float) -> dict:
    """The day's spending after a reading of a meter that counts up within a window. Only increases count; a lower reading
    of the same window is stale and refunds nothing, nor does it lower the base. A new day starts at zero from the last
    reading. A new window that starts on a new day starts from its first reading; one that starts within a day adds its
    first reading, and leaves that day uncertain, as what the old window's end held is not known."""
    same = state["day"] == day
    s = {**state, "day": day, "spent": state["spent"] if same else 0.0, "uncertain": state["uncertain"] if same else ""}
    if s["reading"] is None:
        return {**s, "window": window, "reading": reading}
    if s["window"] == window:
        return {**s, "spent": s["spent"] + max(0.0, reading - s["reading"]), "reading": max(reading, s["reading"])}
    return {**s, "window": window, "reading": reading} | ({"spent": s["spent"] + reading, "uncertain": day} if same else {})


def budget_status(spent: float, reading: float | None, uncertain: bool, limit: float, ended: bool = False) -> str:
    """ready, daily_limit (the day's limit is reached, or the day is uncertain), weekly_limit (the window is used up) or
    quota_unavailable (no reading, or one of a window that has ended). Without a limit a budget is always ready."""
    if limit <= 0:
        return "ready"
    if reading is None or ended:
        return "quota_unavailable"
    return "weekly_limit" if reading >= WHOLE else "daily_limit" if uncertain or spent >= limit else "ready"


def daily_meter(readings: DataFrame, limit: float) -> DataFrame:
    """readings: account, n (order), day, window, reading; windows of an account follow one another. ``meter_step`` over
    each account in order, as columns: account, day, spent, uncertain, status at the end of each day.

    Increases are differences of a running maximum within (account, window); whether a window starts within a day is seen
    from one row a window. No task needs all of an account."""
    r = readings.where("account IS NOT NULL AND day IS NOT NULL AND window IS NOT NULL AND reading IS NOT NULL")
    w = Window.partitionBy("account", "window").orderBy("n")
    high, base = F.max("reading").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.max("reading").over(w.rowsBetween(Window.unboundedPreceding, -1))
    steps = r.withColumns({"high": high, "base": base})
    spans = r.groupBy("account", "window").agg(F.min("n").alias("first_n"), F.min_by("day", "n").alias("first_day"), F.max_by("day", "n").alias("last_day"))
    starts = spans.withColumn("inside", F.coalesce(F.lag("last_day").over(Window.partitionBy("account").orderBy("first_n")) == F.col("first_day"), F.lit(False))).select("account", "window", "inside")
    known = steps.join(starts, ["account", "window"])
    added = F.when(F.col("base").isNotNull(), F.col("high") - F.col("base")).when(F.col("inside"), F.col("reading")).otherwise(0.0)
    days = known.groupBy("account", "day").agg(F.sum(added).alias("spent"), F.bool_or(F.col("base").isNull() & F.col("inside")).alias("uncertain"), F.max_by("high", "n").alias("last"))
    return days.select("account", "day", "spent", "uncertain", status(F.col("spent"), F.col("last"), F.col("uncertain"), limit).alias("status"))


def status(spent: Column, reading: Column, uncertain: Column, limit: float) -> Column:
    """``budget_status`` as a column."""
    if limit <= 0:
        return F.lit("ready")
    return F.when(reading.isNull(), "quota_unavailable").when(reading >= WHOLE, "weekly_limit").when(uncertain | (spent >= limit), "daily_limit").otherwise("ready")


def circuit_stream(outcomes: DataFrame) -> DataFrame:
    """outcomes: service, ts, job, ok as a stream. The state of the circuit after each batch of a service."""
    import json

    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = json.loads(state.get[0]) if state.exists else dict(CLOSED)
        last = None
        for row in sorted((r for f in frames for r in f.itertuples(index=False)), key=lambda r: r.ts):
            s, last = breaker_step(s, row.ts.value / 1e9, row.job, bool(row.ok)), row.ts
        state.update((json.dumps(s),))
        yield pd.DataFrame({"service": [key[0]], "state": [s["state"]], "at": [last]})

    return outcomes.groupBy("service").applyInPandasWithState(step, "service string, state string, at timestamp", "s string", "update", GroupStateTimeout.NoTimeout)
