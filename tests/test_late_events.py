import random

import pytest

from tidemark.operators.late_events import LambdaView, found
from tidemark.sources.tables import DAY_US

SCHEMA = "src string, rec_id string, event_day int, arrived_us long, extra string"
WEEK = 19723  # Monday 2024-01-01
END = (WEEK + 7) * DAY_US


def test_boundaries_ties_repeats_and_nulls(spark, rows):
    log = spark.createDataFrame([
        ("v", "in_time", WEEK, END - 1, None), ("v", "at_end", WEEK + 6, END, "x"), ("v", "last", WEEK, END + 14 * DAY_US - 1, None), ("v", "cut", WEEK, END + 14 * DAY_US, None),
        ("v", "twice", WEEK, END + 5, None), ("v", "twice", WEEK, END - 5, None), ("v", "null_day", None, END, None), ("v", None, WEEK, END, None), ("v", "null_arrival", WEEK, None, None),
        ("w", "at_end", WEEK, END, None), ("v", "old", -3, END, None),
    ], SCHEMA)
    got = rows(found(LambdaView(), log), "src", "rec_id", "week_day", "outcome")
    assert got == [("v", "at_end", WEEK, "corrects"), ("v", "cut", WEEK, "dropped"), ("v", "last", WEEK, "corrects"), ("v", "old", -3, "dropped"), ("w", "at_end", WEEK, "corrects")]


def test_empty_log(spark):
    assert found(LambdaView(), spark.createDataFrame([], SCHEMA)).count() == 0


def test_batch_layer_replaces_open_weeks_and_keeps_frozen_ones(spark, rows):
    view = LambdaView()
    log = spark.createDataFrame([("v", "a", WEEK, END - 1, None), ("v", "b", WEEK, END + 1, None), ("v", "c", WEEK, END + 30 * DAY_US, None)], SCHEMA)
    first = view.batch_recompute(log, view.empty(spark), END)
    assert rows(first, "provisional", "corrections", "final", "state") == [(1, 0, 1, "open")]
    second = view.batch_recompute(log, first, END + 15 * DAY_US)
    assert rows(second, "provisional", "corrections", "dropped", "final", "state") == [(1, 1, 0, 2, "frozen")]
    third = view.batch_recompute(log, second, END + 40 * DAY_US)
    assert rows(third, "provisional", "corrections", "dropped", "final", "state") == [(1, 1, 1, 2, "frozen")]
    # Without the log a frozen week stands as it is.
    assert rows(view.batch_recompute(log.limit(0), third, END + 50 * DAY_US), "dropped", "final", "state") == [(1, 2, "frozen")]


def test_layers_compose(spark, rows):
    """The batch layer takes the fast layer's view; the fast layer counts a repeat again and drops what a frozen week gets."""
    view = LambdaView()
    batch = lambda *r: spark.createDataFrame([("v", i, WEEK, at, None) for i, at in r], SCHEMA)
    one = view.fast_increment(view.empty(spark), batch(("a", END - 9)))
    two = view.fast_increment(one, batch(("b", END + 1), ("a", END + 2)))
    assert rows(two, "week_day", "provisional", "corrections", "final", "state") == [(WEEK, 1, 2, 3, "open")]
    whole = batch(("a", END - 9), ("b", END + 1), ("a", END + 2))
    three = view.batch_recompute(whole, two, END + 14 * DAY_US)
    assert rows(three, "provisional", "corrections", "final", "state") == [(1, 1, 2, "frozen")]
    four = view.fast_increment(three, batch(("c", END + 3), ("d", END + 20 * DAY_US)))
    assert rows(four, "provisional", "corrections", "dropped", "final", "state") == [(1, 1, 2, 2, "frozen")]
    assert rows(view.judged(view.records(batch(("c", END + 3))), four), "rec_id", "outcome") == [("c", "dropped")]


@pytest.mark.parametrize("runs", [1, 3, 7])
def test_a_replay_equals_one_batch_over_the_log(spark, rows, runs):
    rng, view = random.Random(runs), LambdaView()
    log = []
    for i in range(600):
        day, src = WEEK - 7 * 6 + rng.randrange(70), rng.choice("vvw")
        at = (day + rng.choice([0, 3, 8, 15, 22, 40])) * DAY_US + rng.choice([0, 0, 5])
        log += [(src, str(i), day, at + k * DAY_US, None) for k in range(rng.choice([1, 1, 3]))]
    log.append(("v", "fresh", WEEK + 120, (WEEK + 120) * DAY_US, None))
    rng.shuffle(log)
    df = spark.createDataFrame(log, SCHEMA)
    got, judged = view.replay(df, runs)
    records = view.records(df).withColumn("outcome", view.outcome())
    columns = ["src", "week_day", "provisional", "corrections", "dropped", "final"]
    assert rows(got, *columns) == rows(view.counts(records), *columns)
    assert rows(judged, "src", "rec_id", "week_day", "outcome") == rows(records, "src", "rec_id", "week_day", "outcome")
    assert {r["state"] for r in got.collect()} == {"open", "frozen"}
