"""Writing: appends that ignore known keys, versions by partition, archives with a manifest, copies, lists, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append_new(df: DataFrame, path: str, keys: list[str], partition_by: list[str] | None = None) -> None:
    """Appends the rows whose keys the table does not hold yet; repeats within the rows count once."""
    spark = df.sparkSession
    fresh = df.dropDuplicates(keys)
    if exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    w = fresh.write.mode("append")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replaces exactly the partitions that the rows name."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def archive(df: DataFrame, path: str) -> DataFrame:
    """Compressed CSV and a manifest: file, rows, sha256 of its bytes."""
    df.write.mode("overwrite").csv(path, header=True, compression="gzip")
    spark = df.sparkSession
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv.gz").load(path)
    rows = spark.read.csv(path, header=True, schema=df.schema).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("rows"))
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    sums = files.select(name(F.col("path")).alias("file"), F.sha2("content", 256).alias("sha256"), "length")
    return sums.join(rows.select(name(F.col("file")).alias("file"), "rows"), "file", "left").select("file", F.coalesce("rows", F.lit(0)).alias("rows"), "sha256", "length")


def copy_tables(spark: SparkSession, source: str, target: str, names: list[str]) -> DataFrame:
    """Copies tables and returns the rows read back of each."""
    for n in names:
        spark.read.parquet(f"{source}/{n}.parquet").write.mode("overwrite").parquet(f"{target}/{n}.parquet")
    from functools import reduce

    return reduce(DataFrame.unionByName, [spark.read.parquet(f"{target}/{n}.parquet").agg(F.count("*").alias("rows")).withColumn("name", F.lit(n)) for n in names])


def write_urls(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct().write.mode("overwrite").text(path)


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """Distinct addresses of a list; blank lines and comments are skipped."""
    t = spark.read.text(path).select(F.trim("value").alias("url"))
    return t.where("url <> '' AND NOT startswith(url, '#')").distinct()


def export_json(df: DataFrame, order: list[str], path: str) -> None:
    df.orderBy(*order).write.mode("overwrite").json(path)


def read_blobs(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Whole objects: path, length, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", "content")
