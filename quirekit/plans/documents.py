"""Queries of the sources and sinks: markup is written and read again, and the lines are what they were."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirekit.functions import geometry as ge
from quirekit.operators.evaluation import last_by
from quirekit.plans.inputs import LINES, REGIONS, lines, table
from quirekit.plans.registry import query
from quirekit.sources import markup as mu
from quirekit.sources import transcriptions as tr


def written(s, d):
    """Lines of orders as lines of documents."""
    points = F.array(*(F.struct(x.cast("int").alias("x"), y.cast("int").alias("y")) for x, y in ((F.col("x"), F.col("y") + F.col("h")), (F.col("x") + F.col("w"), F.col("y") + F.col("h")))))
    edge = F.transform(ge.rectangle(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")), lambda p: F.struct(p["x"].cast("int").alias("x"), p["y"].cast("int").alias("y")))
    return lines(s, d).select(
        F.col("page").alias("page_id"), F.when(F.col("x") < 500, "a").otherwise("b").alias("region_id"), F.col("line").cast("int").alias("line_pos"), F.format_string("l%d", "line").alias("line_id"), points.alias("baseline"), edge.alias("polygon"),
        F.col("h").cast("double").alias("ascender"), F.lit(2.5).alias("descender"), F.when(F.col("line") % 7 != 0, F.format_string('text & <%d> "of" line', "line")).alias("transcription"), (F.col("w") / 200).alias("confidence"),
    )


def pages(s, d):
    return lines(s, d).select(F.col("page").alias("page_id")).distinct().withColumns({"width": F.lit(1200), "height": F.lit(1600)})


def page_xml(s, d):
    return mu.to_page_xml(written(s, d), pages(s, d))


_DOC = f"{LINES}, docs AS (SELECT page AS page_id, CASE WHEN x < 500 THEN 'a' ELSE 'b' END AS region_id, line::INT AS line_pos, concat('l', line) AS line_id, concat(x, ',', y + h, ' ', x + w, ',', y + h) AS baseline, concat(x, ',', y, ' ', x + w, ',', y, ' ', x + w, ',', y + h, ' ', x, ',', y + h) AS polygon, h::DOUBLE AS ascender, 2.5::DOUBLE AS descender, CASE WHEN line % 7 <> 0 THEN format('text & <{{}}> \"of\" line', line) END AS transcription, w / 200.0 AS confidence FROM lines)"


@query("s02_page_xml", f"WITH {_DOC} SELECT page_id, region_id, line_pos, line_id, baseline, polygon, ascender, descender, transcription, CASE WHEN transcription IS NOT NULL THEN round(confidence, 3) END AS confidence FROM docs")
def s02(s, d):
    back = mu.parse_page_xml(page_xml(s, d))
    return back.withColumns({c: ge.printed_points(F.col(c)) for c in ("baseline", "polygon")})


@query("k01_page_xml", f"""WITH {_DOC}, x AS (SELECT page_id, region_id, line_pos, concat('<TextLine id="', line_id, '" index="', line_pos, '" custom="heights_v2:[', printf('%.1f', ascender), ',', printf('%.1f', descender), ']"><Coords points="', polygon, '"/><Baseline points="', baseline, '"/>',
 CASE WHEN transcription IS NOT NULL THEN concat('<TextEquiv conf="', printf('%.3f', confidence::DOUBLE), '"><Unicode>', replace(replace(replace(replace(transcription, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '</Unicode></TextEquiv>') ELSE '' END, '</TextLine>') AS x FROM docs),
r AS (SELECT page_id, region_id, concat('<TextRegion id="', region_id, '">', string_agg(x, '' ORDER BY line_pos), '</TextRegion>') AS x FROM x GROUP BY page_id, region_id)
SELECT page_id, concat('<PcGts xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15"><Page imageFilename="', page_id, '.jpg" imageWidth="1200" imageHeight="1600">', string_agg(x, '' ORDER BY region_id), '</Page></PcGts>') AS xml FROM r GROUP BY page_id""")
def k01(s, d):
    return page_xml(s, d)


@query("s08_alto_xml", f"WITH {_DOC} SELECT page_id, region_id, d.transcription, l.h::DOUBLE AS ascender, l.h::DOUBLE * 0 AS descender, l.x::INT AS x0, (l.x + l.w)::INT AS x1 FROM docs d JOIN lines l ON l.line = d.line_pos WHERE transcription IS NOT NULL AND confidence >= 0.3")
def s08(s, d):
    back = mu.parse_alto_xml(mu.to_alto_xml(written(s, d), pages(s, d), 0.3))
    return back.select("page_id", "region_id", "transcription", "ascender", "descender", F.get("baseline", F.lit(0))["x"].alias("x0"), F.get("baseline", F.lit(1))["x"].alias("x1"))


@query("k04_alto_xml")
def k04(s, d):
    return mu.to_alto_xml(written(s, d), pages(s, d), 0.3)


@query("c13_namespaces", "SELECT DISTINCT o_custkey AS page_id, 'http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15' AS namespace FROM orders")
def c13(s, d):
    return page_xml(s, d).select("page_id", mu.schema_of(F.col("xml")).alias("namespace"))


@query("c12_ids", "SELECT c_custkey, concat('id_', c_name) AS export_id, regexp_replace(c_name, '[^A-Za-z0-9_.\\-]', '_', 'g') AS safe_id FROM customer")
def c12(s, d):
    return table(s, d, "customer").select("c_custkey", mu.export_id(F.col("c_name"), True).alias("export_id"), mu.safe_id(F.col("c_name")).alias("safe_id"))


@query("c14_stems", "SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem FROM pages")
def c14(s, d):
    return table(s, d, "pages").select("page_id", mu.stem(F.col("url")).alias("stem"))


@query("s03_line_heights", "SELECT DISTINCT o_orderkey AS line, CASE o_orderkey % 3 WHEN 0 THEN 10.5 WHEN 1 THEN 8 ELSE 4 END::DOUBLE AS ascender, CASE o_orderkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 5 ELSE 6 END::DOUBLE AS descender FROM orders")
def s03(s, d):
    custom = F.when(F.col("line") % 3 == 0, "heights:[1,2] heights_v2:[10.5,3.0]").when(F.col("line") % 3 == 1, "heights:[8,1,5,1]").otherwise("heights:[1,4,7]")
    above, below = mu.line_heights(custom)
    return lines(s, d).select("line", above.alias("ascender"), below.alias("descender"))


@query("s10_transcriptions", "SELECT user_id::VARCHAR AS id, arg_max(concat(event_type, ' ', event_id), event_id) AS text FROM events GROUP BY user_id")
def s10(s, d):
    rows = table(s, d, "events").select(F.concat_ws(" ", "user_id", "event_type", "event_id").alias("value"), F.col("event_id").alias("pos"))
    return tr.latest(tr.parsed(rows)).select("id", "text")


@query("s11_parsed_lines", "SELECT user_id::VARCHAR AS id, event_type AS embedding, event_id::VARCHAR AS text, event_id AS pos FROM events")
def s11(s, d):
    return tr.parsed(table(s, d, "events").select(F.concat_ws(" ", "user_id", "event_type", "event_id").alias("value"), F.col("event_id").alias("pos")), True)


@query("k10_transcription_lines", "SELECT concat(conv_id, '-', turn, ' ', text) AS value FROM conversations WHERE text <> ''")
def k10(s, d):
    return tr.lines_of(table(s, d, "conversations").select(F.concat("conv_id", F.lit("-"), "turn").alias("id"), "text"))


@query("k11_annotations", f"WITH {_DOC} SELECT page_id, concat(page_id, '-', line_id, '.jpg ', transcription) AS value FROM docs WHERE transcription IS NOT NULL")
def k11(s, d):
    rows = written(s, d).where("transcription <> ''")
    return rows.select("page_id", F.concat("page_id", F.lit("-"), "line_id", F.lit(".jpg "), "transcription").alias("value"))


@query("s19_processed", "SELECT user_id::VARCHAR AS id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def s19(s, d):
    return tr.processed(table(s, d, "events").select(F.col("event_type").alias("folder"), F.concat("user_id", F.lit(".xml")).alias("name")))


@query("j05_images_with_xml", "SELECT coalesce(c.c_custkey, o.page) AS id, CASE WHEN o.page IS NULL THEN 'image only' WHEN c.c_custkey IS NULL THEN 'xml only' ELSE 'both' END AS side FROM (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0) c FULL OUTER JOIN (SELECT DISTINCT o_custkey AS page FROM orders) o ON c.c_custkey = o.page")
def j05(s, d):
    images = table(s, d, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("id"), F.lit(True).alias("i"))
    xml = pages(s, d).select(F.col("page_id").alias("id"), F.lit(True).alias("x"))
    return images.join(xml, "id", "full_outer").select("id", F.when(F.col("x").isNull(), "image only").when(F.col("i").isNull(), "xml only").otherwise("both").alias("side"))


@query("j07_results_by_position", f"WITH {LINES}, n AS (SELECT page, line, row_number() OVER (PARTITION BY page ORDER BY line) - 1 AS pos FROM lines) SELECT page, line, event_type AS text FROM n JOIN (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events) e ON e.user_id = n.page AND e.pos = n.pos")
def j07(s, d):
    from pyspark.sql import Window as W

    numbered = lines(s, d).select("page", "line", (F.row_number().over(W.partitionBy("page").orderBy("line"))).alias("pos"))
    results = table(s, d, "events").select(F.col("user_id").alias("page"), F.col("event_type").alias("text"), F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).alias("pos"))
    return numbered.join(results, ["page", "pos"]).select("page", "line", "text")


@query("j14_regions_in_order", f"WITH {REGIONS} SELECT page, region, row_number() OVER (PARTITION BY page ORDER BY region DESC)::INT AS place FROM regions")
def j14(s, d):
    from pyspark.sql import Window as W

    from quirekit.plans.inputs import regions

    return regions(s, d).select("page", "region", F.row_number().over(W.partitionBy("page").orderBy(F.desc("region"))).alias("place"))


@query("s21_files", "SELECT user_id AS stem, max(event_id) AS path FROM events GROUP BY user_id")
def s21(s, d):
    """Of files with one stem, the last."""
    return last_by(table(s, d, "events").select(F.col("user_id").alias("stem"), F.col("event_id").alias("path")), ["stem"], [F.desc("path")])
