from tidemark.operators.snapshot_diff import diff, snapshot_pairs

ROWS = "snapshot string, key string, a string, b int, x float"


def test_changes_with_nulls_duplicates_and_empty_snapshots(spark, rows):
    pairs = spark.createDataFrame([("n", "o"), ("e", "o"), ("f", "e")], "child string, parent string")
    data = spark.createDataFrame([
        ("o", "same", "t", 1, 0.0), ("n", "same", "t", 1, 9.0), ("o", "null_to_value", None, 1, 0.0), ("n", "null_to_value", "", 1, 0.0), ("o", "moved_null", None, 1, 0.0), ("n", "moved_null", "1", None, 0.0),
        ("o", "gone", "t", 1, 0.0), ("n", "new", "t", 1, 0.0), ("n", "new", "t", 1, 0.0), ("n", None, "t", 1, 0.0), ("f", "first", "t", 1, 0.0), ("z", "other", "t", 1, 0.0),
    ], ROWS)
    got = rows(diff(pairs, data, ["a", "b"]), "child", "key", "change_kind")
    removed = [("e", k, "removed") for k in ("gone", "moved_null", "null_to_value", "same")]
    assert got == sorted([("n", "null_to_value", "changed"), ("n", "moved_null", "changed"), ("n", "gone", "removed"), ("n", "new", "added"), ("f", "first", "added"), *removed], key=repr)


def test_pairs_need_a_ready_child_and_an_existing_parent(spark, rows):
    s = spark.createDataFrame([("A ", " p", "ready"), ("b", "p", "failed"), ("c", "nowhere", "ready"), ("p", None, "failed"), ("A", "p", "ready")], "id string, parent_snapshot_id string, status string")
    assert rows(snapshot_pairs(s), "child", "parent") == [("a", "p")]


def test_empty(spark):
    assert diff(spark.createDataFrame([], "child string, parent string"), spark.createDataFrame([], ROWS), ["a"]).count() == 0
