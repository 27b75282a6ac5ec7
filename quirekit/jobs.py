"""Jobs for spark-submit: parse a folder by a configuration, merge engines' results, compare transcriptions, choose an embedding."""

from __future__ import annotations

import argparse
from configparser import ConfigParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirekit.operators import evaluation as ev
from quirekit.operators import hypotheses as hy
from quirekit.sources import markup as mu
from quirekit.sources import transcriptions as tr
from quirekit.sources.logits import read_logits, write_logits
from quirekit.sources.markup_trees import lines_of, regions_of, trees
from quirekit.sources.settings import choose_embedding
from quirekit.stages import Pages, parser


def loaded(documents: DataFrame, logits: DataFrame | None = None) -> Pages:
    """Pages of PAGE documents (page_id, xml)."""
    parsed = trees(documents)
    return Pages(parsed.select("page_id", "width", "height"), regions_of(parsed), lines_of(parsed).select(*mu._COLUMNS), logits)


def written(p: Pages, xml: str | None = None, alto: str | None = None, texts: str | None = None, logits: str | None = None) -> None:
    """Writes what is asked for: PAGE and ALTO documents as rows (page_id, xml) of Parquet, lines of text, scores."""
    order = p.regions.select("page_id", "region_id", F.col("region_pos").alias("index"))
    if xml:
        mu.to_page_xml(p.lines, p.pages, order, regions_of_pages=p.regions).write.mode("append").parquet(xml)
    if alto:
        mu.to_alto_xml(p.lines, p.pages).write.mode("append").parquet(alto)
    if texts:
        tr.lines_of(p.lines.select(F.concat_ws("-", "page_id", "line_id").alias("id"), F.col("transcription").alias("text"))).write.mode("append").text(texts)
    if logits:
        if p.logits is None:
            raise ValueError("there are no scores to write")
        write_logits(p.logits, logits)


def parse_folder(spark: SparkSession, config: ConfigParser, skip_processed: bool = False, **stages) -> Pages:
    """Runs a configuration over the documents of its PARSE_FOLDER section: INPUT_XML_PATH and INPUT_LOGIT_PATH; outputs are OUTPUT_XML_PATH, OUTPUT_ALTO_PATH, OUTPUT_TRANSCRIPTIONS_PATH and OUTPUT_LOGIT_PATH, each if given.

    With skip_processed, pages that OUTPUT_XML_PATH has already are left out."""
    where = config["PARSE_FOLDER"]
    documents = mu.documents_in(spark, where["INPUT_XML_PATH"])
    out = where.get("OUTPUT_XML_PATH")
    if skip_processed and out:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            documents = documents.join(spark.read.parquet(out).select("page_id"), "page_id", "left_anti")
    logits = read_logits(spark, where["INPUT_LOGIT_PATH"]) if where.get("INPUT_LOGIT_PATH") else None
    done = parser(config, **stages)(loaded(documents, logits))
    written(done, out, where.get("OUTPUT_ALTO_PATH"), where.get("OUTPUT_TRANSCRIPTIONS_PATH"), where.get("OUTPUT_LOGIT_PATH"))
    return done


def merge(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(page_id, line_id, text, confidence, engine) of the lines of several engines' folders: each line from the engine that is surest of it, by its confidence above 0; else the first folder's."""
    engines = None
    for i, folder in enumerate(folders):
        lines = mu.read_page_xml(spark, folder).select("page_id", "line_id", F.lit(i).alias("engine"), F.col("transcription").alias("text"), F.coalesce("confidence", F.lit(-10.0)).alias("confidence"))
        engines = lines if engines is None else engines.union(lines)
    return hy.merged(engines, engines.where("engine = 0").drop("engine"), ["page_id", "line_id"])


def compare(spark: SparkSession, reference: str, hypothesis: str) -> DataFrame:
    """Error rates of each page and, with null for the page, of all, between the lines of two folders."""
    side = lambda folder: mu.read_page_xml(spark, folder).select("page_id", "line_id", F.col("transcription").alias("text"))
    return ev.micro(ev.scored(ev.paired(side(reference), side(hypothesis), ["page_id", "line_id"])), ["page_id"])


def compare_texts(spark: SparkSession, reference: str, hypothesis: str) -> DataFrame:
    """The report of k13 on the text files that two folders have by one name."""
    return ev.report(tr.read_texts(spark, reference).select(F.col("name").alias("file"), F.col("text").alias("ref")).join(tr.read_texts(spark, hypothesis).select(F.col("name").alias("file"), F.col("text").alias("hyp")), "file"))


def sampled_lines(lines: DataFrame, most: int, n: int, seed: int) -> DataFrame:
    """(page_id, lines): n of the first `most` lines with a text, in the order of pages and lines, drawn by a hash with a seed, and grouped by page."""
    first = lines.where(F.coalesce("transcription", F.lit("")) != "").orderBy("page_id", "region_id", "line_pos", "line_id").limit(most)
    drawn = first.orderBy(F.xxhash64("page_id", "line_id", F.lit(seed)), "page_id", "line_id").limit(n)
    return drawn.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("line_id", "transcription"))).alias("lines"))


def stored_lines(store: DataFrame, data: DataFrame, most: int, n: int, seed: int) -> DataFrame:
    """(id, value, text): n of the first `most` rows of a data file, parsed (id, embedding, text, pos), that a key-value table (id, value) has with a text, drawn by a hash with a seed."""
    first = data.join(store, "id").where(F.col("value").isNotNull() & (F.coalesce("text", F.lit("")) != "")).orderBy("pos").limit(most)
    return first.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n).select("id", "value", "text")


def select_embedding(lines: DataFrame, settings: str, out: str | None = None) -> str:
    """The embedding of the least error rate over lines (embed_id, ref, hyp), written to a recogniser's settings."""
    best = ev.best_group(lines.withColumns({"errors": F.levenshtein("ref", "hyp"), "ref_len": F.length("ref")}), "embed_id").first()["embed_id"]
    choose_embedding(settings, best, out)
    return best


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="quirekit")
    sub = top.add_subparsers(dest="job", required=True)
    p = sub.add_parser("parse-folder")
    p.add_argument("-c", "--config", required=True)
    p.add_argument("-s", "--skip-processed", action="store_true")
    for name in ("input-xml-path", "input-logit-path", "output-xml-path", "output-alto-path", "output-logit-path", "output-transcriptions-path"):
        p.add_argument(f"--{name}")
    p = sub.add_parser("merge-results")
    p.add_argument("folders", nargs="+")
    p.add_argument("--output", required=True)
    for name in ("compare-pages", "compare-texts"):
        p = sub.add_parser(name)
        p.add_argument("--reference", required=True)
        p.add_argument("--hypothesis", required=True)
        p.add_argument("--output", required=True)
    p = sub.add_parser("select-embedding")
    p.add_argument("--lines", required=True)
    p.add_argument("--settings", required=True)
    p.add_argument("--output")
    a = top.parse_args(argv)
    spark = SparkSession.builder.appName(f"quirekit {a.job}").getOrCreate()
    if a.job == "parse-folder":
        config = ConfigParser()
        config.read(a.config, encoding="utf-8")
        if not config.has_section("PARSE_FOLDER"):
            config.add_section("PARSE_FOLDER")
        for name in ("input_xml_path", "input_logit_path", "output_xml_path", "output_alto_path", "output_logit_path", "output_transcriptions_path"):
            if getattr(a, name):
                config["PARSE_FOLDER"][name.upper()] = getattr(a, name)
        parse_folder(spark, config, a.skip_processed)
    elif a.job == "merge-results":
        merge(spark, a.folders).write.parquet(a.output)
    elif a.job == "compare-pages":
        compare(spark, a.reference, a.hypothesis).write.parquet(a.output)
    elif a.job == "compare-texts":
        compare_texts(spark, a.reference, a.hypothesis).write.option("header", True).csv(a.output)
    else:
        select_embedding(spark.read.parquet(a.lines), a.settings, a.output)
