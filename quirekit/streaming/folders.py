"""Runs that follow a folder: documents are taken once each, as they arrive, and a run that is started again goes on where it stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quirekit.jobs import loaded
from quirekit.sources import markup as mu
from quirekit.stages import Stage


def follow(spark: SparkSession, folder: str, out: str, checkpoint: str, stage: Stage, files_each: int = 10_000) -> StreamingQuery:
    """Starts a run of a stage over the PAGE documents of a folder that the checkpoint doesn't know yet, files_each at a time, until none is left.

    The documents of each batch go to a folder of its own under `out`, batch=N, written over if the batch is run again: so each is there once."""
    found = spark.readStream.option("pathGlobFilter", "*.[xX][mM][lL]").option("maxFilesPerTrigger", files_each).text(folder, wholetext=True)
    documents = found.select(mu.stem(F.input_file_name()).alias("page_id"), F.col("value").alias("xml"))

    def one(batch: DataFrame, n: int) -> None:
        done = stage(loaded(batch))
        order = done.regions.select("page_id", "region_id", F.col("region_pos").alias("index"))
        mu.to_page_xml(done.lines, done.pages, order, regions_of_pages=done.regions).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return documents.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
