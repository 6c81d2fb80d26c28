"""Parquet tables and the reading rules that every table shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
#: Blanks that may stand around an id.
BLANKS = " \t\r\n 　"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def norm_id(c: Column | str) -> Column:
    """An id without outer blanks in lower case; a blank id is null."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.lower(F.trim(c, F.lit(BLANKS)))
    return F.when(F.length(t) > 0, t)


def epoch_us(c: Column | str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session's zone."""
    c = F.col(c) if isinstance(c, str) else c
    c = c.cast("timestamp_ntz")
    clock = F.hour(c) * 3600 + F.minute(c) * 60
    return F.unix_date(c.cast("date")).cast("long") * DAY_US + clock.cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def epoch_day(c: Column | str) -> Column:
    """Days since 1970 of a zone-less timestamp."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_date(c.cast("timestamp_ntz").cast("date"))
