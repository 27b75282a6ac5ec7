"""Runs of configured stages over pages: layout, recognition, decoding, confidences and filters, each a function from Pages to Pages."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from configparser import ConfigParser
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirekit.functions import geometry as ge
from quirekit.operators import decoding as de
from quirekit.operators import layout as la
from quirekit.operators import scoring as sc
from quirekit.sources.logits import own_frames


@dataclass(frozen=True)
class Pages:
    """pages (page_id, width, height), regions (page_id, region_pos, region_id, type, polygon, transcription), lines as of sources.markup, and scores as of sources.logits, if any."""

    pages: DataFrame
    regions: DataFrame
    lines: DataFrame
    logits: DataFrame | None = None


Stage = Callable[[Pages], Pages]
#: Methods that work on pixels; a run needs a plug-in of that name for them.
PIXELS = ("REGION_SIMPLE_THRESHOLD", "LAYOUT_CNN", "LINES_SIMPLE_THRESHOLD")


def _flag(config: Mapping[str, str], name: str) -> bool:
    return str(config.get(name, "no")).strip().lower() in ("1", "yes", "true", "on")


def _boxed(lines: DataFrame) -> DataFrame:
    """lines with page, line, x, y, w, h of their edge and dx, dy of their baseline."""
    b = ge.box(F.col("polygon"))
    end = F.element_at("baseline", -1)
    return lines.withColumns({"page": F.col("page_id"), "line": F.col("line_id"), "x": b["hpos"], "y": b["vpos"], "w": b["width"], "h": b["height"], "dx": end["x"] - F.get("baseline", F.lit(0))["x"], "dy": end["y"] - F.get("baseline", F.lit(0))["y"]})


def whole_page(config: Mapping[str, str]) -> Stage:
    """One region as large as its page; it has no lines yet."""

    def run(p: Pages) -> Pages:
        xy = F.array(*(F.struct(x.cast("int").alias("x"), y.cast("int").alias("y")) for x, y in ((F.lit(0), F.lit(0)), (F.col("width"), F.lit(0)), (F.col("width"), F.col("height")), (F.lit(0), F.col("height")))))
        regions = p.pages.select("page_id", F.lit(0).alias("region_pos"), F.lit("r1").alias("region_id"), F.lit(None).cast("string").alias("type"), xy.alias("polygon"), F.lit(None).cast("string").alias("transcription"))
        return replace(p, regions=regions, lines=p.lines.limit(0))

    return run


def line_filter(config: Mapping[str, str]) -> Stage:
    """Drops lines that hug the page's edges (FILTER_INCOMPLETE_PAGES), the lines of pages whose longest is short (FILTER_PAGES_WITH_SHORT_LINES, LENGTH_THRESHOLD) and regions without lines."""
    if _flag(config, "FILTER_DIRECTIONS"):
        raise ValueError("FILTER_DIRECTIONS needs directions predicted from pixels: plug in LINE_FILTER")
    incomplete, short = _flag(config, "FILTER_INCOMPLETE_PAGES"), _flag(config, "FILTER_PAGES_WITH_SHORT_LINES")
    least = float(config.get("LENGTH_THRESHOLD", 0))

    def run(p: Pages) -> Pages:
        lines = _boxed(p.lines).join(p.pages.select("page_id", "width"), "page_id")
        if incomplete:
            lines = la.inner_lines(lines, F.col("width"))
        if short:
            lines = la.long_pages(lines, least)
        lines = lines.select(p.lines.columns)
        return replace(p, lines=lines, regions=p.regions.join(lines, ["page_id", "region_id"], "left_semi"))

    return run


def line_postprocessing(config: Mapping[str, str]) -> Stage:
    """Baselines stretched at both ends (STRETCH_LINES) and resampled to ten points (RESAMPLE_LINES); edges are made anew from baselines and heights."""
    stretch, resample = config.get("STRETCH_LINES", "0"), _flag(config, "RESAMPLE_LINES")
    if stretch == "max":
        raise ValueError("STRETCH_LINES = max needs the regions' edges on the pixels' grid: plug in LINE_POSTPROCESSING")

    def run(p: Pages) -> Pages:
        real = lambda c: F.transform(c, lambda q: F.struct(q["x"].cast("double").alias("x"), q["y"].cast("double").alias("y")))
        whole = lambda c: F.transform(c, lambda q: F.struct(F.rint(q["x"]).cast("int").alias("x"), F.rint(q["y"]).cast("int").alias("y")))
        base = real(F.col("baseline"))
        if int(stretch):
            base = ge.stretched(base, int(stretch))
        if resample:
            base = ge.resampled_straight(base)
        lines = p.lines.withColumn("baseline", whole(base))
        edge = ge.outline(real(F.col("baseline")), F.col("ascender"), F.col("descender"))
        return replace(p, lines=lines.withColumn("polygon", whole(edge)).select(p.lines.columns))

    return run


def sorter(smart: bool) -> Callable[[Mapping[str, str]], Stage]:
    """Regions in reading order: by upper edge, or by cuts between them."""

    def make(config: Mapping[str, str]) -> Stage:
        def run(p: Pages) -> Pages:
            b = ge.box(F.col("polygon"))
            boxes = p.regions.select(F.col("page_id").alias("page"), F.col("region_id").alias("region"), b["hpos"].alias("x0"), b["vpos"].alias("y0"), (b["hpos"] + b["width"]).alias("x1"), (b["vpos"] + b["height"]).alias("y1"))
            placed = la.smart_order(boxes) if smart else la.top_down(boxes.withColumnRenamed("y0", "y"), "region")
            place = placed.select(F.col("page").alias("page_id"), F.col("region").alias("region_id"), (F.col("place") - 1).cast("int").alias("place"))
            return replace(p, regions=p.regions.join(place, ["page_id", "region_id"]).withColumn("region_pos", F.col("place")).select(p.regions.columns))

        return run

    return make


METHODS: dict[str, Callable[[Mapping[str, str]], Stage]] = {"REGION_WHOLE_PAGE": whole_page, "LINE_FILTER": line_filter, "LINE_POSTPROCESSING": line_postprocessing, "REGION_SORTER_NAIVE": sorter(False), "REGION_SORTER_SMART": sorter(True)}


def layout_stage(config: Mapping[str, str], plugins: Mapping[str, Callable[[Mapping[str, str]], Stage]] = {}) -> Stage:  # noqa: B006
    """The stage of a section's METHOD; plug-ins come first, and methods on pixels need one."""
    method = config["METHOD"]
    if method in plugins:
        return plugins[method](config)
    if method in PIXELS or method == "LAYOUT_POSTPROCESSING":
        raise ValueError(f"{method} works on pixels: plug it in")
    if method not in METHODS:
        raise ValueError(f"unknown layout method: {method}")
    return METHODS[method](config)


def recognised(lines: DataFrame, infer: Callable[[Sequence[bytes], int], Sequence], budget: int, characters: Sequence[str], pad: int = 32) -> DataFrame:
    """Scores (as of sources.logits) of lines (page_id, line_id, w, crop): infer(crops, width) gives the frames of each crop of a batch, padded to one width.

    Batches are of lines of like width, as many as fit the budget of pixels across, so one call holds a bounded number of crops. A batch is a group of its own, and batches are spread among the tasks."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["page_id", "line_id"])
        frames = infer([bytes(c) for c in pdf.crop], int(key[0]))
        if len(frames) != len(pdf):
            raise ValueError("the recogniser gave frames for another number of lines")
        return pd.DataFrame({"page_id": pdf.page_id, "line_id": pdf.line_id, "frames": [[[float(v) for v in f] for f in line] for line in frames], "first_frame": 0, "last_frame": [len(f) for f in frames]})

    batches = la.batched(lines.withColumn("line", F.concat_ws("/", "page_id", "line_id")), [], budget, pad)
    found = batches.groupBy("padded", "batch").applyInPandas(run, "page_id string, line_id string, frames array<array<double>>, first_frame int, last_frame int")
    return found.withColumn("characters", F.array(*map(F.lit, characters)))


def decoded(letters: Sequence[str], k: int = 8, carry: bool = False, sure: float = float("inf"), lm=None, lm_scale: float = 1.0) -> Stage:
    """Lines that have scores get the text that the decoder reads, page by page in the order of regions and lines; a line that can't be decoded keeps its own."""

    def run(p: Pages) -> Pages:
        over = W.partitionBy("page_id").orderBy("region_pos", "line_pos", "line_id")
        placed = p.lines.join(p.regions.select("page_id", "region_id", "region_pos"), ["page_id", "region_id"]).withColumn("at", F.row_number().over(over))
        asked = placed.join(p.logits, ["page_id", "line_id"]).select(F.col("page_id").alias("page"), F.col("at").alias("line"), sc.log_probabilities(own_frames()).alias("logp"), F.col("transcription").alias("text"))
        said = de.decode_pages(asked, letters, k, lm, lm_scale, carry=carry, sure=sure).select(F.col("page").alias("page_id"), F.col("line").alias("at"), F.col("text").alias("said"))
        lines = placed.join(said, ["page_id", "at"], "left").withColumn("transcription", F.coalesce("said", "transcription"))
        return replace(p, lines=lines.select(p.lines.columns))

    return run


def with_confidences(p: Pages) -> Pages:
    """Lines that have scores get the least confidence of their symbols; others keep theirs."""
    if p.logits is None:
        return p
    found = p.logits.select("page_id", "line_id", sc.line_confidence(sc.log_probabilities(own_frames())).alias("sure"))
    lines = p.lines.join(found, ["page_id", "line_id"], "left").withColumn("confidence", F.coalesce("sure", "confidence"))
    return replace(p, lines=lines.select(p.lines.columns))


def parser(config: ConfigParser, plugins: Mapping[str, Callable] = {}, decoder: Stage | None = None, recogniser: Stage | None = None) -> Stage:  # noqa: B006
    """The run that a configuration's PAGE_PARSER section asks for: LAYOUT_PARSER_1 to _9, recognition and decoding where they are to run, then confidences and the filter by confidence."""
    section = config["PAGE_PARSER"]
    stages: list[Stage] = []
    if section.getboolean("RUN_LAYOUT_PARSER", fallback=False):
        stages += [layout_stage(config[f"LAYOUT_PARSER_{i}"], plugins) for i in range(1, 10) if config.has_section(f"LAYOUT_PARSER_{i}")]
    for flag, stage in (("RUN_OCR", recogniser), ("RUN_DECODER", decoder)):
        if section.getboolean(flag, fallback=False):
            if stage is None:
                raise ValueError(f"{flag} needs a stage")
            stages.append(stage)
    threshold = section.getfloat("FILTER_CONFIDENT_LINES_THRESHOLD", fallback=-1.0)

    def run(p: Pages) -> Pages:
        for stage in stages:
            p = stage(p)
        p = with_confidences(p)
        return replace(p, lines=la.confident(p.lines, threshold))

    return run
