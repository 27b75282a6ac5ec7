"""Scores of symbols by line, as Parquet: frames, the symbols that they score, and the frames that are the line's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "page_id string, line_id string, frames array<array<double>>, characters array<string>, first_frame int, last_frame int"


def write_logits(lines: DataFrame, path: str, missing_ok: bool = False) -> None:
    """Writes the scores of lines (columns of SCHEMA). A line without a part of them stops the job with its id, unless missing_ok: then it is left out."""
    whole = F.col("frames").isNotNull() & F.col("characters").isNotNull() & F.col("first_frame").isNotNull() & F.col("last_frame").isNotNull()
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    if missing_ok:
        lines = lines.where(whole)
    else:
        lines = lines.withColumn("frames", F.when(whole, F.col("frames")).otherwise(F.raise_error(F.concat(F.lit("the scores of line "), F.coalesce(F.col("line_id").cast("string"), F.lit("?")), F.lit(" are incomplete"))).cast("array<array<double>>")))
    lines.select(columns).write.parquet(path)


def read_logits(spark: SparkSession, path: str) -> DataFrame:
    """Scores as rows of SCHEMA; files without characters or frames' bounds give nulls for them."""
    found = spark.read.parquet(path)
    return found.select(*(F.col(n).cast(t) if n in found.columns else F.lit(None).cast(t).alias(n) for n, t in (c.split(" ", 1) for c in SCHEMA.split(", "))))


def onto_lines(lines: DataFrame, logits: DataFrame) -> DataFrame:
    """lines with their scores; lines that have none keep nulls."""
    return lines.join(logits, ["page_id", "line_id"], "left")


def own_frames(frames: str = "frames") -> Column:
    """The frames from first_frame to before last_frame; all where these are null."""
    first, last = F.coalesce("first_frame", F.lit(0)), F.coalesce("last_frame", F.size(frames))
    return F.slice(frames, first + 1, F.greatest(last - first, F.lit(0)))
