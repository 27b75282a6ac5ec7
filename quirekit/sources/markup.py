"""Page markup: reading and writing of PAGE and ALTO documents, as rows of lines.

lines are (page_id, region_id, line_pos, line_id, baseline, polygon, ascender, descender, transcription, confidence).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirekit.functions.geometry import box, printed_points
from quirekit.sources.markup_trees import lines_of, trees

NAMESPACES = {"2019": "http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15", "2013": "http://schema.primaresearch.org/PAGE/gts/pagecontent/2013-07-15"}
_COLUMNS = ("page_id", "region_id", "line_pos", "line_id", "baseline", "polygon", "ascender", "descender", "transcription", "confidence")


def line_heights(custom: Column) -> tuple[Column, Column]:
    """(ascender, descender) of a line's custom attribute: heights_v2 as they are; of older heights, of 4 the first and third, of 3 the second and the third less the first."""
    new = F.from_json(F.regexp_extract(custom, r"heights_v2:\s*(\[[^\]]*\])", 1), "array<double>")
    old = F.from_json(F.regexp_extract(custom, r"heights:\s*(\[[^\]]*\])", 1), "array<double>")
    pick = lambda i: F.when(F.size(new) > 1, F.get(new, F.lit(i))).when(F.size(old) == 4, F.get(old, F.lit(2 * i))).when(F.size(old) == 3, F.get(old, F.lit(1)) if i == 0 else F.get(old, F.lit(2)) - F.get(old, F.lit(0))).otherwise(F.get(old, F.lit(i)))
    return pick(0), pick(1)


def parse_page_xml(texts: DataFrame) -> DataFrame:
    """Lines of PAGE documents in a column: (page_id, xml). A line without a baseline is left out, a missing text is null, an empty one ''; documents that can't be parsed have none."""
    return lines_of(trees(texts)).select(*_COLUMNS)


def documents_in(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, xml): the XML files in a folder, each whole; page_id is the file's name without its extension."""
    files = spark.read.option("pathGlobFilter", "*.[xX][mM][lL]").text(path, wholetext=True)
    return files.select(stem(F.input_file_name()).alias("page_id"), F.col("value").alias("xml"))


def read_page_xml(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the PAGE files in a folder; page_id is the image's name without its extension."""
    parsed = trees(documents_in(spark, path))
    return lines_of(parsed.withColumn("page_id", F.coalesce(F.regexp_replace("image", r"\.[^.]*$", ""), "page_id"))).select(*_COLUMNS)


def parse_alto_xml(texts: DataFrame) -> DataFrame:
    """Lines of ALTO documents in a column (page_id, xml): two points as baseline, words joined by spaces, the ascender above and the descender below."""
    return lines_of(trees(texts, "alto")).select("page_id", "region_id", "line_pos", "baseline", "ascender", "descender", "transcription")


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def export_id(c: Column, valid: bool = False) -> Column:
    """An id as it is written: with id_ before it where it must be valid."""
    return F.concat(F.lit("id_"), c) if valid else c


def safe_id(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\w.\-]", "_")


def to_page_xml(lines: DataFrame, pages: DataFrame, order: DataFrame | None = None, valid_ids: bool = False, version: str = "2019", creator: str | None = None, created: str | None = None, regions_of_pages: DataFrame | None = None) -> DataFrame:
    """(page_id, xml) of lines and pages (page_id, width, height): coordinates rounded half to even, heights with one decimal, confidences with three.

    version is 2019 or 2013. With a creator, a document of 2019 says who made it and when: created, an ISO time, or now. order (page_id, region_id, index) is the
    reading order, in which regions are then written. regions_of_pages (page_id, region_id, type, polygon, transcription) gives regions their types, edges and texts; those without a line are written, too."""
    if version not in NAMESPACES:
        raise ValueError(f"unknown version of PAGE: {version}")
    conf = F.when(F.col("confidence").isNotNull(), F.format_string(' conf="%.3f"', "confidence")).otherwise("")
    text = F.when(F.col("transcription").isNotNull(), F.concat(F.lit("<TextEquiv"), conf, F.lit("><Unicode>"), escaped(F.col("transcription")), F.lit("</Unicode></TextEquiv>"))).otherwise("")
    line = F.concat(
        F.lit('<TextLine id="'), escaped(export_id(F.col("line_id"), valid_ids)), F.format_string('" index="%d" custom="heights_v2:[%.1f,%.1f]"><Coords points="', "line_pos", "ascender", "descender"),
        printed_points(F.col("polygon")), F.lit('"/><Baseline points="'), printed_points(F.col("baseline")), F.lit('"/>'), text, F.lit("</TextLine>"),
    )
    regions = lines.select("page_id", "region_id", "line_pos", line.alias("x")).groupBy("page_id", "region_id").agg(F.array_sort(F.collect_list(F.struct("line_pos", "x"))).alias("ls"))
    head, tail = F.lit(""), F.lit("")
    if regions_of_pages is not None:
        known = regions_of_pages.select("page_id", "region_id", "type", "polygon", F.col("transcription").alias("said"))
        regions = regions.join(known, ["page_id", "region_id"], "full_outer")
        head = F.concat(F.when(F.col("polygon").isNotNull(), F.concat(F.lit('<Coords points="'), printed_points(F.col("polygon")), F.lit('"/>'))).otherwise(""))
        tail = F.when(F.col("said").isNotNull(), F.concat(F.lit("<TextEquiv><Unicode>"), escaped(F.col("said")), F.lit("</Unicode></TextEquiv>"))).otherwise("")
    kind = F.when(F.col("type").isNotNull(), F.concat(F.lit('" type="'), escaped(F.col("type")))).otherwise("") if regions_of_pages is not None else F.lit("")
    region = F.concat(F.lit('<TextRegion id="'), escaped(export_id(F.col("region_id"), valid_ids)), kind, F.lit('">'), head, F.coalesce(F.array_join("ls.x", ""), F.lit("")), tail, F.lit("</TextRegion>"))
    place = F.lit(0)
    regions = regions.select("page_id", "region_id", region.alias("x"))
    if order is not None:  # regions that the order doesn't name come last
        regions = regions.join(order.select("page_id", "region_id", F.col("index").alias("place")), ["page_id", "region_id"], "left")
        place = F.coalesce("place", F.lit((1 << 31) - 1))
    body = regions.select("page_id", place.alias("place"), "region_id", "x").groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("place", "region_id", "x")))["x"], "").alias("body"))
    rows = pages.join(body, "page_id", "left")
    placed = F.lit("")
    if order is not None:
        ref = F.format_string('<RegionRefIndexed index="%d" regionRef="%s"/>', "index", "region_id")
        rows = rows.join(order.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("index", ref.alias("x"))))["x"], "").alias("refs")), "page_id", "left")
        placed = F.concat(F.lit('<ReadingOrder><OrderedGroup id="order">'), F.coalesce("refs", F.lit("")), F.lit("</OrderedGroup></ReadingOrder>"))
    about = F.lit("")
    if creator is not None and version == "2019":
        when = F.lit(created) if created is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
        about = F.concat(F.lit("<Metadata><Creator>"), escaped(F.lit(creator)), F.lit("</Creator><Created>"), when, F.lit("</Created><LastChange>"), when, F.lit("</LastChange></Metadata>"))
    head = F.concat(F.lit(f'<PcGts xmlns="{NAMESPACES[version]}">'), about, F.format_string('<Page imageFilename="%s.jpg" imageWidth="%d" imageHeight="%d">', escaped(F.col("page_id").cast("string")), "width", "height"))
    return rows.select("page_id", F.concat(head, placed, F.coalesce("body", F.lit("")), F.lit("</Page></PcGts>")).alias("xml"))


def processing_element(name: str, software_creator: str = "quirekit", software_name: str = "quirekit", software_version: str = "1", when: str | None = None) -> Column:
    """The element of an ALTO document that says what software made it, and when: an ISO time, or now."""
    time = F.lit(when) if when is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    step = "".join(f"<{k}>{v}</{k}>" for k, v in (("softwareCreator", software_creator), ("softwareName", software_name), ("softwareVersion", software_version)))
    return F.concat(F.lit(f'<OCRProcessing ID="{name}"><ocrProcessingStep><processingDateTime>'), time, F.lit(f"</processingDateTime><processingSoftware>{step}</processingSoftware></ocrProcessingStep></OCRProcessing>"))


def to_alto_xml(lines: DataFrame, pages: DataFrame, min_confidence: float = 0.0, processing: Column | None = None) -> DataFrame:
    """(page_id, xml): blocks, lines and words in boxes; blank lines and those below min_confidence are left out. A word's width is its share of the line's letters.

    lines may have word_confidences, an array in the order of the words: a line's confidence is then the median of letter_confidences, an array, if there is one, else of those of
    its words. Otherwise each word has its line's. processing is an element about the software, as of processing_element()."""
    if "word_confidences" in lines.columns:
        of = "letter_confidences" if "letter_confidences" in lines.columns else "word_confidences"
        middle = lambda xs: (F.get(F.array_sort(xs), F.floor((F.size(xs) - 1) / 2).cast("int")) + F.get(F.array_sort(xs), F.floor(F.size(xs) / 2).cast("int"))) / 2
        lines = lines.withColumn("confidence", F.when(F.size(of) > 0, middle(F.col(of))).otherwise(F.col("confidence")))
        sure = lambda i: F.coalesce(F.get("word_confidences", i), "confidence", F.lit(1.0))
    else:
        sure = lambda i: F.coalesce("confidence", F.lit(1.0))
    b = box(F.col("polygon"))
    kept = lines.where((F.trim(F.coalesce("transcription", F.lit(""))) != "") & (F.coalesce("confidence", F.lit(1.0)) >= min_confidence)).select("*", b.alias("b"), F.split(F.trim("transcription"), r"\s+").alias("ws"))
    n = F.length(F.array_join("ws", " "))
    before = lambda i: F.aggregate(F.slice("ws", F.lit(1), i), F.lit(0), lambda a, w: a + F.length(w) + 1)
    word = F.transform("ws", lambda w, i: F.concat(F.lit('<String CONTENT="'), escaped(w), F.format_string('" WC="%.2f" HPOS="%d" VPOS="%d" WIDTH="%d" HEIGHT="%d"/>', sure(i), (F.col("b.hpos") + F.col("b.width") * before(i) / n).cast("int"), F.col("b.vpos").cast("int"), (F.col("b.width") * F.length(w) / n).cast("int"), F.col("b.height").cast("int"))))
    line = F.concat(F.format_string('<TextLine BASELINE="%d" HPOS="%d" VPOS="%d" WIDTH="%d" HEIGHT="%d">', F.get("baseline", F.lit(0))["y"].cast("int"), F.col("b.hpos").cast("int"), F.col("b.vpos").cast("int"), F.col("b.width").cast("int"), F.col("b.height").cast("int")), F.array_join(word, "<SP/>"), F.lit("</TextLine>"))
    rows = kept.select("page_id", "region_id", "line_pos", "b", line.alias("x"))
    corner = [F.min("b.hpos").cast("int").alias("x0"), F.min("b.vpos").cast("int").alias("y0"), F.max(F.col("b.hpos") + F.col("b.width")).cast("int").alias("x1"), F.max(F.col("b.vpos") + F.col("b.height")).cast("int").alias("y1")]
    blocks = rows.groupBy("page_id", "region_id").agg(F.array_sort(F.collect_list(F.struct("line_pos", "x")))["x"].alias("ls"), *corner)
    place = lambda: F.format_string('HPOS="%d" VPOS="%d" WIDTH="%d" HEIGHT="%d">', "x0", "y0", F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    block = F.concat(F.lit('<TextBlock ID="'), escaped(safe_id(F.col("region_id"))), F.lit('" '), place(), F.array_join("ls", ""), F.lit("</TextBlock>"))
    spaces = blocks.select("page_id", "region_id", block.alias("x"), "x0", "y0", "x1", "y1").groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("region_id", "x")))["x"], "").alias("body"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    space = F.when(F.col("body").isNotNull(), F.concat(F.lit("<PrintSpace "), place(), F.col("body"), F.lit("</PrintSpace>"))).otherwise("<PrintSpace/>")
    about = F.concat(F.lit("<Description>"), processing, F.lit("</Description>")) if processing is not None else F.lit("")
    head = F.concat(F.lit('<alto xmlns="http://www.loc.gov/standards/alto/ns-v2#">'), about, F.format_string('<Layout><Page ID="id_%s" WIDTH="%d" HEIGHT="%d">', escaped(safe_id(F.col("page_id").cast("string"))), "width", "height"))
    return pages.join(spaces, "page_id", "left").select("page_id", F.concat(head, space, F.lit("</Page></Layout></alto>")).alias("xml"))


def schema_of(xml: Column) -> Column:
    """The namespace of a document."""
    return F.regexp_extract(xml, r'xmlns="([^"]*)"', 1)


def stem(path: Column) -> Column:
    """A file's name without its folder and its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")
