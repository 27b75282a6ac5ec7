"""Transcription files: one line of text for each image, `id text` or `id embedding text`; folders of texts, images and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirekit.sources.markup import stem


def parsed(rows: DataFrame, embeddings: bool = False) -> DataFrame:
    """(id, embedding, text, pos) of rows (value, pos); raises for a line without its spaces, with its place."""
    n = 2 if embeddings else 1
    parts = F.split(F.regexp_replace("value", r"\r?\n$", ""), " ", n + 1)
    bad = F.raise_error(F.format_string("line %d has too few fields", "pos"))
    ok = F.when(F.size(parts) == n + 1, parts).otherwise(bad.cast("array<string>"))
    return rows.select(ok.alias("p"), "pos").select(F.get("p", F.lit(0)).alias("id"), (F.get("p", F.lit(1)) if embeddings else F.lit(None).cast("string")).alias("embedding"), F.get("p", F.lit(n)).alias("text"), "pos")


def latest(rows: DataFrame) -> DataFrame:
    """One row for each id, the last one."""
    return rows.groupBy("id").agg(F.max_by(F.struct("embedding", "text"), "pos").alias("s")).select("id", "s.*")


def read(spark: SparkSession, path: str, embeddings: bool = False) -> DataFrame:
    """The transcriptions of a file; of repeated ids the last counts."""
    rows = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("pos"))
    return latest(parsed(rows, embeddings))


def lines_of(rows: DataFrame) -> DataFrame:
    """`id text` of each row with a text."""
    return rows.where(F.coalesce("text", F.lit("")) != "").select(F.concat_ws(" ", "id", "text").alias("value"))


def write(rows: DataFrame, path: str) -> None:
    """A file for each task, in the order of ids within it."""
    lines_of(rows.sortWithinPartitions("id")).write.text(path)


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(name, text) of the text files in a folder, each whole."""
    return spark.read.option("pathGlobFilter", "*.[tT][xX][tT]").text(folder, wholetext=True).select(stem(F.input_file_name()).alias("name"), F.col("value").alias("text"))


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(name, content) of the pictures in a folder, undecoded."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png,JPG,JPEG,PNG}").load(folder).select(stem(F.col("path")).alias("name"), "content")


def processed(names: DataFrame) -> DataFrame:
    """(id) of the results that are in every folder: names (folder, name), the id being what precedes .logits, .xml or .jpg."""
    ids = names.select("folder", F.regexp_extract("name", r"^(.*?)\.(?:logits|xml|jpg)", 1).alias("id")).where("id <> ''").distinct()
    folders = names.where("folder is not null").agg(F.count_distinct("folder").alias("folders"))
    return ids.groupBy("id").agg(F.count("*").alias("n")).crossJoin(F.broadcast(folders)).where("n = folders").select("id")
