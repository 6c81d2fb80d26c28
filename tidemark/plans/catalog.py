"""All named queries outside the llm subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions import text as X
from tidemark.plans import aggregate_queries, core_queries, filter_join_queries, scalar_queries, snapshot_queries, source_queries, stream_queries

MODULES = [core_queries, filter_join_queries, aggregate_queries, scalar_queries, snapshot_queries, source_queries, stream_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}


def run(spark: SparkSession, folder: str, name: str, **parameters) -> DataFrame:
    """A query by name with parameters, where it takes any: the extension point for new queries is a catalogue."""
    every = queries()
    if name not in every:
        raise LookupError(f"no query is called {name!r}")
    return every[name](spark, folder, **parameters)


def register_views(spark: SparkSession, folder: str) -> None:
    """Temporary views of the folder's tables, for queries in SQL."""
    for f in spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(spark._jvm.org.apache.hadoop.fs.Path(folder)):
        name = f.getPath().getName()
        if name.endswith(".parquet"):
            spark.read.parquet(f"{folder}/{name}").createOrReplaceTempView(name[:-8])


def register_functions(spark: SparkSession) -> None:
    """The scalar functions as temporary functions of the session, so that SQL can call them."""
    spark.udf.register("normalize_fold", X.nfkc_fold)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION snake_key(t STRING) RETURNS STRING RETURN btrim(regexp_replace(lower(btrim(coalesce(t, ''))), '[^0-9a-z]+', '_'), '_')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION ascii_part(t STRING) RETURNS STRING RETURN regexp_replace(coalesce(t, ''), '[^\\\\x00-\\\\x7F]', '')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION token_estimate(t STRING) RETURNS INT RETURN length(coalesce(t, '')) - length(ascii_part(t)) + CAST(floor((length(ascii_part(t)) + 3) / 4) AS INT)")
