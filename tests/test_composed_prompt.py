"""Prompts hold the whole text."""

import duckdb

from tidemark.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def test_whole_text(spark, tmp_path):
    text = "x" * 79 + "{{date}} 文{{blocks}}\n$1 \\ end " * 400
    rows = [("a", "summary", "de", text), ("b", "summary", None, None), ("c", "brief", "de", text), ("d", "summary", "en", "")]
    spark.createDataFrame(rows, "doc_id string, doc_kind string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["prompt"] for r in catalog.queries()["tx24_composed_prompt"](spark, str(tmp_path)).collect()}
    assert got == {"a": "# de\n" + text, "b": "# \n", "d": "# en\n"}


def test_whole_table(spark):
    got = sorted(tuple(r) for r in catalog.queries()["tx24_composed_prompt"](spark, FOLDER).collect())
    want = duckdb.sql(f"SELECT doc_id, '# ' || coalesce(lang, '') || chr(10) || coalesce(text, '') FROM '{FOLDER}/documents.parquet' WHERE doc_kind = 'summary'").fetchall()
    assert got == sorted(want) and max(len(p) for _, p in got) > 200
