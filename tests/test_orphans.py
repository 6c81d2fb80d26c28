import random

from tidemark.operators import orphans as O

REFS, PARENTS = "src string, rec_id string, kind string, key string, made_us long, note string", "kind string, key string, gone boolean, came_us long, note int"


def test_states_ties_nulls_and_repeats(spark, rows):
    refs = spark.createDataFrame([
        ("a", "ok", "v", "k1", 10, None), ("a", "tie", "v", "k1", 5, None), ("a", "early", "v", "k1", 4, None), ("a", "miss", "v", "k9", 10, "x"), ("a", "gone", "v", "k2", 10, None), ("a", "null", "v", None, 10, None),
        ("a", "other_kind", "w", "k1", 10, None), ("a", "rep", "v", "k1", 3, None), ("a", "rep", "v", "k1", 9, None), ("a", "no_time", "v", "k1", None, None),
    ], REFS)
    parents = spark.createDataFrame([("v", "k1", False, 5, 1), ("v", "k1", False, 8, 2), ("v", "k2", True, 99, None), ("v", None, False, 1, 1)], PARENTS)
    assert rows(O.find_orphans(refs, parents), "rec_id", "ref_state") == [("early", "later"), ("gone", "deleted"), ("miss", "missing"), ("other_kind", "missing"), ("rep", "later")]


def test_empty_tables(spark):
    refs, parents = spark.createDataFrame([("a", "x", "v", "k", 1, None)], REFS), spark.createDataFrame([], PARENTS)
    assert [r["ref_state"] for r in O.find_orphans(refs, parents).collect()] == ["missing"]
    assert O.find_orphans(refs.limit(0), parents).count() == 0


def test_runs_of_integers(spark, rows):
    df = spark.createDataFrame([("v", "d", 0, i) for i in (1, 2, 3, 7, 8, 12)] + [("w", "d", 0, 5)], "kind string, prefix string, block long, ik long")
    assert rows(O.key_runs(df), "kind", "run_start", "run_end") == [("v", 1, 3), ("v", 12, 12), ("v", 7, 8), ("w", 5, 5)]


def test_keys_are_integers_behind_a_prefix(spark):
    """No two keys share prefix and integer, and neighbours of one series are neighbours."""
    keys = ["0", "12", "012", "000000000012", "65535", "65536", "999999999999999999", "1234567890123456789", "5f0c0f5e-8f2e-4d6b-9a53-0000000000ff", "5f0c0f5e-8f2e-4d6b-9a53-000000000100", "s/5f0c0f5e-8f2e-4d6b-9a53-0000000000ff", "k7", "", "line\n000000000012"]
    got = {r["key"]: (r["prefix"], r["ik"], r["block"]) for r in O.integer_keys(spark.createDataFrame([("v", k) for k in keys], "kind string, key string")).collect()}
    assert len({g[:2] for g in got.values()}) == len(keys)
    assert got["12"] == ("d", 12, 0) and got["65536"][2] == 1 and got["5f0c0f5e-8f2e-4d6b-9a53-000000000100"][1] - got["5f0c0f5e-8f2e-4d6b-9a53-0000000000ff"][1] == 1


def test_against_sets_with_a_hot_key(spark):
    rng = random.Random(3)
    held = {f"k{i}" for i in range(400) if rng.random() < 0.7}
    refs = [("s", str(i), "v", "k7" if i % 3 == 0 else f"k{rng.randrange(500)}", 1, None) for i in range(5000)]
    got = {(r["rec_id"], r["ref_state"]) for r in O.find_orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame([("v", k, False, 0, 0) for k in held], PARENTS)).collect()}
    assert got == {(r[1], "missing") for r in refs if r[3] not in held}


def test_a_reference_of_no_type_is_missing(spark, tmp_path):
    from tidemark.plans.core_queries import p4_found

    made = "CAST(timestamp_ntz'2025-01-01 00:00:00' AS timestamp_ntz) AS created_at"
    tables = {
        "asset": f"SELECT 'a' id, CAST(null AS string) video_id, {made} WHERE false", "video": f"SELECT 'v' id, CAST(null AS string) status, {made}", "event_map_snapshot": f"SELECT 's' id, {made}",
        "event_record": f"SELECT 'r' revision_id, {made}", "event_map_canonical": "SELECT 's' snapshot_id, 'c' canonical_id",
        "brief_reference": f"SELECT * FROM VALUES ('1', CAST(null AS string), 'v', 's'), ('2', 'source', ' V ', null), ('3', 'canonical', 'c', null), ('4', 'source', null, 'x') AS t(id, object_type, object_id, snapshot_id), (SELECT {made})",
    }
    for name, sql in tables.items():
        spark.sql(sql).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {(r["src"].split(".")[1], r["rec_id"], r["month_key"], r["ref_state"]) for r in p4_found(spark, str(tmp_path)).collect()}
    assert got == {("object_id", "1", "2025-01", "missing"), ("object_id", "3", "2025-01", "missing"), ("snapshot_id", "4", "2025-01", "missing")}


def test_references_are_matched_to_runs_of_parents_alone(spark, rows):
    at = lambda k, i: ("v", k, "d", 0, i)
    runs = spark.createDataFrame([("v", "d", 0, 1, 3), ("v", "d", 0, 6, 6)], "kind string, prefix string, block long, run_start long, run_end long")
    asked = spark.createDataFrame([at(str(i), i) for i in range(8)] + [("v", "x", "e", 0, 2)], "kind string, key string, prefix string, block long, ik long")
    got = rows(O.match_runs(asked, runs), "key", "run_start", "run_end")
    assert got == [("0", None, None), ("1", 1, 3), ("2", 1, 3), ("3", 1, 3), ("4", 1, 3), ("5", 1, 3), ("6", 6, 6), ("7", 6, 6), ("x", None, None)]


def test_numbered_keys(spark, rows):
    held = [k for k in range(65_000, 66_500) if k not in (65_100, 65_536)]
    parents = spark.createDataFrame([("v", str(k), False, 0, 0) for k in held], PARENTS)
    refs = spark.createDataFrame([("s", str(k), "v", str(k), 1, None) for k in (64_999, 65_000, 65_100, 65_535, 65_536, 65_537, 66_499, 66_500)], REFS)
    assert rows(O.find_orphans(refs, parents), "rec_id") == [("64999",), ("65100",), ("65536",), ("66500",)]
    assert O.key_runs(O.integer_keys(parents.select("kind", "key"))).count() == 3
