"""Deep chains of descendants and videos with many titles lose nothing."""

from tidemark.operators import relational as R
from tidemark.plans import catalog


def test_deep_descendants(spark):
    n = 20
    edges = spark.createDataFrame([("000", None)] + [(f"{i:03}", f"{i - 1:03}") for i in range(1, n)] + [("x", "001"), ("lone", None)], "id string, parent string")
    got = {tuple(r) for r in R.closure(edges, edges.where("parent IS NULL"), "id", "parent").collect()}
    assert got == {("000", f"{i:03}", i) for i in range(n)} | {("000", "x", 2), ("lone", "lone", 0)}


def test_many_titles(spark, tmp_path):
    n = 1900
    rows = [("v", f"title {i:05}") for i in range(n)] + [("v", "title 00000"), ("v", None), ("w", "one"), (None, "no video")]
    spark.createDataFrame(rows, "source_video_id string, title string").write.parquet(f"{tmp_path}/event_record.parquet")
    run = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()
    want = {("v", i * 2000 + 500, (i + 1) * 2000 + 500, f"title {i:05}") for i in range(n)} | {("w", 500, 2500, "one")}
    for name in ("src07_srt_segments", "src08_vtt_segments"):
        got = run(name)
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert {tuple(r) for r in run("src09_normalized_subtitles")} == {("v", "\n".join(f"title {i:05}" for i in range(n)), n), ("w", "one", 1)}
