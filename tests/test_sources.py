import struct
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.operators.publish import Publisher, build_key
from tidemark.sources import scene, sinks, subtitles

SRT = "﻿1\r\n00:00:01,500 --> 00:00:02,000\r\nHello\r\nworld\r\n\r\n2\r\n00:01:00,000 --> 00:01:01,250\r\n\r\n3\r\n01:00:00,000 --> 01:00:00,001\r\n<i>last</i>\r\n"
VTT = "WEBVTT\n\nNOTE nothing\n\nintro\n00:01.500 --> 00:02.000 align:start\nHello\nworld\n\n01:00:00.000 --> 01:00:00.001\nlast\n"


def test_subtitles(spark, tmp_path):
    (tmp_path / "a.srt").write_text(SRT, newline="")
    (tmp_path / "b.vtt").write_text(VTT)
    (tmp_path / "c.txt").write_text("no")
    got = {r["path"][-5:]: r for r in subtitles.read_subtitles(spark, str(tmp_path)).collect()}
    want = [(1500, 2000, "Hello world"), (3_600_000, 3_600_001, "last")]
    assert {k: [tuple(s) for s in r["segments"]] for k, r in got.items()} == {"a.srt": want, "b.vtt": want}
    assert got["a.srt"]["plain"] == "Hello world\nlast"
    assert [tuple(r) for r in spark.createDataFrame([(None,), ("",), ("no cue",)], "t string").select(subtitles.segments(F.col("t"))).collect()] == [(None,), ([],), ([],)]


def test_scene_round_trip(spark):
    ids = [str(uuid.UUID(int=i + 1)) for i in range(5)]
    rows = [(i, ids[i], float(i), 0.5, -1.0, 10 + i, 20, 3, 2, i % 2 == 0, i == 1, i, None if i == 2 else 7, None) for i in range(5)]
    schema = "point int, canonical_id string, x float, y float, z float, start_day int, end_day int, type_code int, precision_code int, uncertain boolean, disagrees boolean, members int, macro int, local int"
    raw = b"".join(scene.stream(scene.encode(spark.createDataFrame(rows, schema)), rows=2))
    assert scene.RECORD.itemsize == 56 == struct.calcsize("<I16sfffiiBBBBIII")
    r = scene.decode(raw, 5)
    assert bytes(r["id"][3]) == uuid.UUID(ids[3]).bytes and r["flags"].tolist() == [1, 2, 1, 0, 1] and r["macro"].tolist() == [7, 7, scene.NO_TOPIC, 7, 7]
    with pytest.raises(ValueError):
        scene.decode(raw[:-1], 5)
    with pytest.raises(ValueError):
        list(scene.stream(scene.encode(spark.createDataFrame(rows[1:], schema))))
    assert scene.index_bytes([3, 1]) == struct.pack("<II", 1, 3)


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(r, "id string, snapshot_id string, v int")
    sinks.append_new(rows(("a", "s", 1), ("a", "s", 2), ("b", "s", 1)), path, ["id"], ["snapshot_id"])
    sinks.append_new(rows(("b", "s", 9), ("c", "t", 1)), path, ["id"], ["snapshot_id"])
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]
    sinks.replace_partitions(rows(("z", "t", 5)), path, ["snapshot_id"])
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == ["a", "b", "z"]
    m = sinks.archive(rows(("a", "s", 1), ("b", "s", 2)), str(tmp_path / "arc")).collect()
    assert sum(r["rows"] for r in m) == 2 and all(len(r["sha256"]) == 64 for r in m)
    urls = spark.createDataFrame([("https://a",), ("https://a",), (None,)], "url string")
    sinks.write_urls(urls, "url", str(tmp_path / "u"))
    assert [r["url"] for r in sinks.read_urls(spark, str(tmp_path / "u")).collect()] == ["https://a"]
    assert sinks.read_blobs(spark, str(tmp_path / "u"), "*.txt").agg(F.sum("length")).first()[0] == len("https://a\n")
    sinks.export_json(rows(("b", "s", 1), ("a", "s", 1)), ["id"], str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_publishing(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "i int, t string")
    p = Publisher(spark, str(tmp_path / "maps"))
    with pytest.raises(LookupError):
        p.read("groups")
    key = build_key(spark, df, {"v": 1})
    assert key == build_key(spark, df.repartition(3), {"v": 1}) != build_key(spark, df, {"v": 2})
    first, reused = p.publish(key, {"groups": df})
    assert not reused and p.publish(key, {"groups": df}) == (first, True) and p.read("groups").count() == 1
    second, _ = p.publish(build_key(spark, df.limit(0), {"v": 1}), {"groups": df.limit(0)})
    assert p.read("groups").count() == 0 and p.read("groups", first).count() == 1
    with pytest.raises(LookupError):
        p.read("groups", "v-unknown")


def test_numbers_without_gaps(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = {r["k"]: r["point"] for r in scene.numbered(df, ["k"]).collect()}
    assert got == {k: k for k in range(1000)}


def test_a_statement_ends_with_its_time(spark):
    from tidemark.session import within

    assert within(spark, 60, lambda: spark.range(5).count()) == 5
    slow = spark.range(0, 1 << 40, 1, 4).selectExpr("sum(hash(id) % 7) AS s")
    with pytest.raises(TimeoutError):
        within(spark, 1.0, slow.collect)
    assert spark.range(3).count() == 3


def test_types_beyond_a_byte(spark):
    from tidemark.operators.projection import type_codes

    df = spark.createDataFrame([(f"t{i:03d}",) for i in range(300)] + [(None,), (" T001 ",)], "kind string")
    got = {r["event_type"]: r["type_code"] for r in type_codes(df, "kind").collect()}
    assert len(got) == 301 and got["other"] == got["t253"] == got["t299"] == 254 and got["t000"] == 1 and got["t252"] == 253
    few = {r["event_type"]: r["type_code"] for r in type_codes(df.where("kind < 't003'"), "kind").collect()}
    assert few == {"t000": 0, "t001": 1, "t002": 2}


def test_tables_of_finished_queries_are_released(spark):
    from tidemark.session import Stages, release

    release(spark)
    kept = Stages(spark, "kept").write(spark.range(3).toDF("x"))
    assert kept.count() == 3 and release(spark) == 1 and release(spark) == 0
    with pytest.raises(Exception):
        spark.read.parquet(kept._tidemark_path)


def test_small_tables_are_dealt_out_and_counted_against_bounds(spark):
    from tidemark.session import small, spread

    one = spark.range(4000).coalesce(1)
    assert spread(one).rdd.getNumPartitions() == 8 and spread(one, 2000).rdd.getNumPartitions() == 2 and spread(one).count() == 4000
    wide = spark.range(100).repartition(20)
    assert spread(wide).rdd.getNumPartitions() == 20 and spread(one.limit(0)).count() == 0
    held = lambda most: "ResolvedHint" in small(spark.range(5), most)._jdf.queryExecution().analyzed().toString()
    assert held(5) and not held(4)
