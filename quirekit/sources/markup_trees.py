"""Reading of PAGE and ALTO documents as trees: any prefix of the namespace, regions within regions, points as attributes or elements, reading orders and line heights.

Spark's own XML reader needs a schema of fixed depth, so documents are parsed by Arrow batches of whole documents. One that can't be parsed gives a row with its error."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_POINTS = "array<struct<x:int,y:int>>"
_LINE = f"struct<region_id:string,line_id:string,line_pos:int,baseline:{_POINTS},polygon:{_POINTS},ascender:double,descender:double,transcription:string,confidence:double>"
_REGION = f"struct<region_id:string,type:string,polygon:{_POINTS},transcription:string>"
_ORDER = "struct<region_id:string,index:int>"
_TREE = f"namespace string, image string, width int, height int, regions array<{_REGION}>, lines array<{_LINE}>, reading_order array<{_ORDER}>, error string"


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _child(e: ET.Element, name: str) -> ET.Element | None:
    return next((c for c in e if _name(c) == name), None)


def _under(e: ET.Element, name: str) -> Iterator[ET.Element]:
    return (c for c in e.iter() if _name(c) == name)


def points_of(e: ET.Element | None) -> list[tuple[float, float]] | None:
    """The points of an element: of its attribute, rounded to whole numbers, else of its Point elements as they are; None without an element."""
    if e is None:
        return None
    if "points" in e.attrib:
        return [(round(float(x)), round(float(y))) for x, y in (p.split(",") for p in e.attrib["points"].split())]
    return [(float(p.attrib["x"]), float(p.attrib["y"])) for p in e if _name(p) == "Point"]


def heights_of(custom: str | None) -> list[float] | None:
    """The heights that a line's custom attribute states: heights_v2 as they are; of 4 older ones the first and third, of 3 the second and the third less the first."""
    if not custom:
        return None
    if m := re.search(r"heights_v2:(\[[^\]]*\])", custom):
        return [float(v) for v in json.loads(m.group(1))]
    if "heights" not in custom:
        return None
    v = [float(x) for x in re.findall(r"\d+", custom)]
    return [v[0], v[2]] if len(v) == 4 else [v[1], v[2] - v[0]] if len(v) == 3 else v


def guessed_heights(baseline: list[tuple[float, float]], polygon: list[tuple[float, float]] | None) -> list[float]:
    """How far a line reaches above and below its baseline: the mean distances to where the baseline's normals at its points leave the polygon.

    A normal counts if it crosses the edge twice. Where none does, 0.8 and 0.2 of the polygon's height stand for them; without a polygon both are 0."""
    if not polygon:
        return [0.0, 0.0]
    p = np.array(polygon, float)
    way = np.array(baseline[0], float) - np.array(baseline[-1], float)
    normal = np.array([-way[1], way[0]])
    found = []
    if normal.any() and len(p) > 2:
        edge = np.roll(p, -1, axis=0) - p
        for at in np.array(baseline, float):
            # at + t * normal = p + s * edge
            cross = normal[0] * edge[:, 1] - normal[1] * edge[:, 0]
            off = p - at
            with np.errstate(divide="ignore", invalid="ignore"):
                t = (off[:, 0] * edge[:, 1] - off[:, 1] * edge[:, 0]) / cross
                s = (off[:, 0] * normal[1] - off[:, 1] * normal[0]) / cross
            hits = np.unique(np.round(t[(cross != 0) & (s >= -1e-12) & (s <= 1 + 1e-12) & (np.abs(t) <= 10)], 9))
            if len(hits) == 2:
                ends = sorted((at + h * normal for h in hits), key=lambda e: e[1])
                found.append([float(np.hypot(*(at - e))) for e in ends])
    if not found:
        tall = float(p[:, 1].max() - p[:, 1].min())
        return [0.8 * tall, 0.2 * tall]
    return [float(v) for v in np.mean(found, axis=0)]


def _number(s: str | None) -> int | None:
    try:
        return int(s) if s is not None else None
    except ValueError:
        return None


def _text(e: ET.Element) -> tuple[str | None, float | None]:
    """(text, confidence) of an element's TextEquiv; the text is '' where that is empty."""
    equiv = _child(e, "TextEquiv")
    if equiv is None:
        return None, None
    u = _child(equiv, "Unicode")
    conf = equiv.get("conf")
    return ("" if u is None else "".join(u.itertext())), float(conf) if conf is not None else None


def page_tree(xml: str) -> dict:
    """A PAGE document: its regions, wherever they are nested, their lines, which every region around them lists too, and the reading order. A line without a baseline is left out."""
    root = ET.fromstring(xml.encode("utf-8") if isinstance(xml, str) else xml)
    page = next(_under(root, "Page"))
    out = {"namespace": root.tag[1:].partition("}")[0] if root.tag[:1] == "{" else None, "image": page.get("imageFilename"), "width": _number(page.get("imageWidth")), "height": _number(page.get("imageHeight")), "regions": [], "lines": [], "error": None}
    order: dict[str, int] = {}
    for group in _under(page, "ReadingOrder"):
        for ref in _under(group, "RegionRefIndexed"):
            order[ref.attrib["regionRef"]] = int(ref.attrib["index"])
    out["reading_order"] = [{"region_id": k, "index": v} for k, v in order.items()]
    for region in _under(page, "TextRegion"):
        out["regions"].append({"region_id": region.get("id"), "type": region.get("type"), "polygon": points_of(_child(region, "Coords")), "transcription": _text(region)[0]})
        for i, line in enumerate(_under(region, "TextLine")):
            baseline = points_of(_child(line, "Baseline"))
            if not baseline:
                continue
            polygon = points_of(_child(line, "Coords"))
            heights = heights_of(line.get("custom")) or guessed_heights(baseline, polygon)
            text, conf = _text(line)
            at = _number(line.get("index"))
            out["lines"].append({"region_id": region.get("id"), "line_id": line.get("id"), "line_pos": i if at is None else at, "baseline": baseline, "polygon": polygon, "ascender": heights[0], "descender": heights[-1], "transcription": text, "confidence": conf})
    return out


def alto_tree(xml: str) -> dict:
    """An ALTO document: its blocks as regions, also those in composed blocks, and its lines: two points as baseline, words joined by spaces, the ascender above the baseline and the descender below."""
    root = ET.fromstring(xml.encode("utf-8") if isinstance(xml, str) else xml)
    page = next(_under(root, "Page"))
    number = lambda e, c: float(e.get(c) or 0)

    def corners(e: ET.Element) -> list[tuple[float, float]]:
        x, y, w, h = (number(e, c) for c in ("HPOS", "VPOS", "WIDTH", "HEIGHT"))
        return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]

    out = {"namespace": root.tag[1:].partition("}")[0] if root.tag[:1] == "{" else None, "image": page.get("ID"), "width": _number(page.get("WIDTH")), "height": _number(page.get("HEIGHT")), "regions": [], "lines": [], "reading_order": [], "error": None}
    for block in _under(page, "TextBlock"):
        out["regions"].append({"region_id": block.get("ID"), "type": None, "polygon": corners(block), "transcription": None})
        for i, line in enumerate(_under(block, "TextLine")):
            x, y, w, h = (number(line, c) for c in ("HPOS", "VPOS", "WIDTH", "HEIGHT"))
            base = float((line.get("BASELINE") or str(y + h)).split()[-1].split(",")[-1])
            words = list(_under(line, "String"))
            conf = [float(s.get("WC")) for s in words if s.get("WC")]
            out["lines"].append({"region_id": block.get("ID"), "line_id": line.get("ID"), "line_pos": i, "baseline": [(x, base), (x + w, base)], "polygon": corners(line), "ascender": base - y, "descender": y + h - base, "transcription": " ".join(s.get("CONTENT", "") for s in words), "confidence": float(np.median(conf)) if conf else None})
    return out


def _rounded(points: list[tuple[float, float]] | None) -> list[dict] | None:
    return None if points is None else [{"x": round(x), "y": round(y)} for x, y in points]


def trees(texts: DataFrame, kind: str = "page") -> DataFrame:
    """(page_id, namespace, image, width, height, regions, lines, reading_order, error) of documents (page_id, xml), of kind page or alto. Coordinates are rounded half to even."""
    read = {"page": page_tree, "alto": alto_tree}[kind]
    names = ("namespace", "image", "width", "height", "regions", "lines", "reading_order", "error")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for xml in batch.column(1).to_pylist():
                try:
                    row = read(xml or "")
                    for r in (*row["regions"], *row["lines"]):
                        r.update({c: _rounded(r[c]) for c in ("baseline", "polygon") if c in r})
                except (ET.ParseError, StopIteration, KeyError, ValueError) as e:
                    row = dict.fromkeys(names) | {"error": f"{type(e).__name__}: {e}"}
                rows.append(row)
            cols = [pa.array([r[c] for r in rows], t) for c, t in zip(names, _ARROW)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["page_id", *names])

    return texts.select("page_id", "xml").mapInArrow(run, f"page_id {texts.schema['page_id'].dataType.simpleString()}, {_TREE}")


_XY = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())]))
_ARROW = (
    pa.string(), pa.string(), pa.int32(), pa.int32(),
    pa.list_(pa.struct([("region_id", pa.string()), ("type", pa.string()), ("polygon", _XY), ("transcription", pa.string())])),
    pa.list_(pa.struct([("region_id", pa.string()), ("line_id", pa.string()), ("line_pos", pa.int32()), ("baseline", _XY), ("polygon", _XY), ("ascender", pa.float64()), ("descender", pa.float64()), ("transcription", pa.string()), ("confidence", pa.float64())])),
    pa.list_(pa.struct([("region_id", pa.string()), ("index", pa.int32())])), pa.string(),
)


def lines_of(parsed: DataFrame) -> DataFrame:
    """The lines of trees(), as rows of markup lines."""
    return parsed.select("page_id", F.explode("lines").alias("l")).select("page_id", "l.*")


def regions_of(parsed: DataFrame) -> DataFrame:
    """(page_id, region_pos, region_id, type, polygon, transcription) of trees()."""
    return parsed.select("page_id", F.posexplode("regions").alias("region_pos", "r")).select("page_id", "region_pos", "r.*")


def order_of(parsed: DataFrame) -> DataFrame:
    """(page_id, region_id, index) of the reading orders of trees()."""
    return parsed.select("page_id", F.explode("reading_order").alias("o")).select("page_id", "o.*")
