"""Subtitle texts to segments, as column expressions: a file is a row, read whole.

Segments are struct(start_ms, end_ms, text); lines of a cue join with a blank, cues without text are dropped, in the
order of the file. Cases: null gives null; text that is no subtitle gives no segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT = "array<struct<start_ms:long,end_ms:long,text:string>>"


def _ms(clock: Column) -> Column:
    """HH:MM:SS.mmm or MM:SS.mmm, with a comma or a dot."""
    parts = F.split(F.replace(clock, F.lit(","), F.lit(".")), r"[:.]")
    n = F.size(parts)
    at = lambda k: F.element_at(parts, k).cast("long")
    hours = F.when(n == 4, at(1)).otherwise(F.lit(0).cast("long"))
    return ((hours * 60 + F.element_at(parts, n - 2).cast("long")) * 60 + F.element_at(parts, n - 1).cast("long")) * 1000 + F.element_at(parts, n).cast("long")


_CLOCK = r"((?:\d{1,3}:)?\d{1,2}:\d{2}[.,]\d{3})"


def segments(text: Column) -> Column:
    """Cues of SRT or WebVTT text: blocks between blank lines that hold a line of two clocks."""
    plain = F.regexp_replace(F.regexp_replace(text, "\\uFEFF", ""), "\r\n?", "\n")
    blocks = F.split(plain, r"\n[ \t]*\n+")
    timed = F.filter(blocks, lambda b: b.rlike(r"(?m)^\s*" + _CLOCK + r"\s*-->\s*" + _CLOCK))

    def cue(b: Column) -> Column:
        line = r"(?s)^.*?" + _CLOCK + r"\s*-->\s*" + _CLOCK + r"[^\n]*"
        body = F.trim(F.regexp_replace(F.regexp_replace(b, line, ""), r"\s*\n\s*", " "))
        clean = F.trim(F.regexp_replace(body, r"</?[a-zA-Z][^>]*>|<\d[^>]*>", ""))
        return F.struct(_ms(F.regexp_extract(b, line, 1)).alias("start_ms"), _ms(F.regexp_extract(b, line, 2)).alias("end_ms"), clean.alias("text"))

    return F.filter(F.transform(timed, cue), lambda s: s["text"] != "")


def plain_text(cues: Column) -> Column:
    return F.array_join(F.transform(cues, lambda s: s["text"]), "\n")


def read_subtitles(spark: SparkSession, folder: str) -> DataFrame:
    """path, segments, segments_json, plain of the .srt and .vtt files of a folder."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.{srt,vtt}").select(F.input_file_name().alias("path"), segments(F.col("value")).alias("segments"))
    return files.select("path", "segments", F.to_json("segments").alias("segments_json"), plain_text(F.col("segments")).alias("plain"))
