"""Queries of the layout operators over the lines and regions of pages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quirekit.functions import geometry as ge
from quirekit.operators import layout as la
from quirekit.plans.inputs import CELLS, LINES, REGIONS, frames, lines, regions, table
from quirekit.plans.registry import query

_POS = f"{LINES}, numbered AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY line) - 1 AS line_pos FROM lines)"
_ASSIGNED = f"""{_POS}, {REGIONS},
assigned AS (SELECT n.page, r.region, format('{{}}-l{{:03d}}', r.region, n.line_pos + 1) AS id, n.line, greatest(n.x, r.x0) AS x0, greatest(n.y, r.y0) AS y0, least(n.x + n.w, r.x1) AS x1, least(n.y + n.h, r.y1) AS y1
 FROM numbered n JOIN regions r ON n.page = r.page AND n.x < r.x1 AND n.x + n.w > r.x0 AND n.y < r.y1 AND n.y + n.h > r.y0)"""


def assigned(s, d):
    return la.assigned(lines(s, d), regions(s, d))


def nested(s, d):
    """Pages of two regions with their lines, in the order of ids."""
    parts = assigned(s, d).groupBy("page", "region").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    return parts.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("region", "lines"))).alias("regions"))


@query("f01_flattened", f"WITH {_ASSIGNED} SELECT page, (dense_rank() OVER (PARTITION BY page ORDER BY region) - 1)::INT AS region_pos, (row_number() OVER (PARTITION BY page, region ORDER BY line) - 1)::INT AS line_pos, line FROM assigned")
def f01(s, d):
    return la.flattened(nested(s, d))


@query("f02_confident", "SELECT event_id, value AS confidence FROM events WHERE value > 40")
def f02(s, d):
    return la.confident(table(s, d, "events").select("event_id", F.col("value").alias("confidence")), 40)


@query("f05_inner_lines", f"WITH {LINES} SELECT page, line FROM lines WHERE NOT ((x < 20 AND x + w <= 125) OR (x + w > 980 AND x >= 875))")
def f05(s, d):
    return la.inner_lines(lines(s, d), 1000).select("page", "line")


@query("f05_at_edge", f"WITH {LINES} SELECT line, ((x < 20 AND x + w <= 125) OR (x + w > 980 AND x >= 875)) AS at_edge FROM lines")
def f05_at_edge(s, d):
    points = F.array(ge.point(F.col("x"), F.col("y")), ge.point(F.col("x") + F.col("w"), F.col("y")))
    return lines(s, d).select("line", ge.at_edge(points, F.lit(1000)).alias("at_edge"))


@query("f06_long_pages", f"WITH {LINES} SELECT page, line FROM lines WHERE page IN (SELECT page FROM lines GROUP BY page HAVING max(w) >= 190)")
def f06(s, d):
    return la.long_pages(lines(s, d), 190).select("page", "line")


@query("f07_filled_regions", f"WITH {_ASSIGNED} SELECT page, region FROM regions r WHERE EXISTS (SELECT 1 FROM assigned a WHERE a.page = r.page AND a.region = r.region AND a.y0 < 300)")
def f07(s, d):
    return la.filled_regions(regions(s, d), assigned(s, d).where("y0 < 300")).select("page", "region")


_ANGLED = f"{LINES}, angled AS (SELECT *, atan2((h - 17) * 20.0, w) AS angle FROM lines), dirs AS (SELECT page, quantile_cont(angle, 0.5) AS direction FROM angled GROUP BY page)"


def angled(s, d):
    return lines(s, d).withColumn("angle", F.atan2((F.col("h") - 17) * 20.0, F.col("w").cast("double")))


@query("f08_line_filter", f"WITH {_ANGLED}, k AS (SELECT a.* FROM angled a JOIN dirs USING (page) WHERE abs(angle) <= pi() / 4 OR least(fmod(abs(angle - direction), 2 * pi()), 2 * pi() - fmod(abs(angle - direction), 2 * pi())) <= pi() / 4), i AS (SELECT * FROM k WHERE NOT ((x < 20 AND x + w <= 125) OR (x + w > 980 AND x >= 875))) SELECT page, line FROM i WHERE page IN (SELECT page FROM i GROUP BY page HAVING max(w) >= 150)")
def f08(s, d):
    a = angled(s, d)
    dirs = a.groupBy("page").agg(F.percentile("angle", 0.5).alias("direction"))
    return la.line_filter(a, 1000, dirs, True, 150).select("page", "line")


@query("f09_along", f"WITH {_ANGLED} SELECT page, line FROM angled JOIN dirs USING (page) WHERE abs(angle) <= pi() / 4 OR least(fmod(abs(angle - direction), 2 * pi()), 2 * pi() - fmod(abs(angle - direction), 2 * pi())) <= pi() / 4")
def f09(s, d):
    a = angled(s, d)
    return la.along(a, a.groupBy("page").agg(F.percentile("angle", 0.5).alias("direction"))).select("page", "line")


_BOXES = f"{LINES}, pairs AS (SELECT a.page, a.line, b.line AS other FROM lines a JOIN lines b ON a.page = b.page AND a.line < b.line AND a.x - 30 < b.x + b.w + 30 AND a.x + a.w + 30 > b.x - 30 AND a.y - 30 < b.y + b.h + 30 AND a.y + a.h + 30 > b.y - 30)"


@query("f19_overlapping_boxes", f"WITH {_BOXES} SELECT page, line, other FROM pairs")
def f19(s, d):
    return la.near_pairs(lines(s, d), 30)


@query("j08_assigned", f"WITH {_ASSIGNED} SELECT page, region, id, line, x0, y0, x1, y1 FROM assigned")
def j08(s, d):
    return assigned(s, d)


@query("j09_clipped", f"WITH {_ASSIGNED} SELECT page, region, line, round((x1 - x0) * (y1 - y0), 4)::DOUBLE AS area FROM assigned")
def j09(s, d):
    edge = lambda df, *keys: df.select(*keys, ge.rectangle(*(F.col(c) for c in ("x0", "y0", "x1", "y1"))).alias("edge"))
    shapes = lines(s, d).withColumns({"x0": F.col("x"), "y0": F.col("y"), "x1": F.col("x") + F.col("w"), "y1": F.col("y") + F.col("h")})
    return la.clipped_parts(edge(shapes, "page", "line"), edge(regions(s, d), "page", "region")).select("page", "region", "line", F.round("area", 4).alias("area"))


@query("j09_clipped_polygons")
def j09_polygons(s, d):
    """Slanted lines in six-sided regions."""
    point = lambda x, y: F.struct(F.expr(x).cast("double").alias("x"), F.expr(y).cast("double").alias("y"))
    shapes = lines(s, d).select("page", "line", F.array(point("x", "y"), point("x + w", "y + h / 2"), point("x + w", "y + 3 * h / 2"), point("x", "y + h")).alias("edge"))
    six = regions(s, d).select("page", "region", F.array(*(point(x, y) for x, y in (("x0 + 100", "y0"), ("x1 - 100", "y0"), ("x1", "y1 / 2"), ("x1 - 100", "y1"), ("x0 + 100", "y1"), ("x0", "y1 / 2")))).alias("edge"))
    return la.clipped_parts(shapes, six).select("page", "region", "line", F.round("area", 4).alias("area"))


@query("j10_row_pairs", f"""WITH {LINES} SELECT a.page, a.line, b.line AS other FROM lines a JOIN lines b ON a.page = b.page AND a.line < b.line
WHERE least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) > 0.7 * least(a.h, b.h) AND NOT ((a.x < b.x AND a.x + a.w > b.x + b.w) OR (b.x < a.x AND b.x + b.w > a.x + a.w)) AND greatest(a.x, b.x) - least(a.x + a.w, b.x + b.w) < 2 * least(a.h, b.h)""")
def j10(s, d):
    return la.row_pairs(lines(s, d))


_COMPONENTS = _BOXES.replace("lines AS", "lines AS", 1) + """, edges AS (SELECT page, line AS a, other AS b FROM pairs UNION ALL SELECT page, other, line FROM pairs),
reach AS (SELECT page, line AS a, line AS b FROM lines UNION SELECT r.page, r.a, e.b FROM reach r JOIN edges e ON e.page = r.page AND e.a = r.b),
clusters AS (SELECT page, a AS line, min(b) AS cluster FROM reach GROUP BY page, a)"""


@query("a30_components", f"WITH RECURSIVE {_COMPONENTS} SELECT page, line, cluster FROM clusters")
def a30(s, d):
    return la.clusters(lines(s, d), la.near_pairs(lines(s, d), 30))


@query("j11_paragraphs", f"WITH RECURSIVE {_COMPONENTS} SELECT page, cluster, count(*) AS lines FROM clusters GROUP BY page, cluster")
def j11(s, d):
    return la.clusters(lines(s, d), la.near_pairs(lines(s, d), 30)).groupBy("page", "cluster").agg(F.count("*").alias("lines"))


@query("a21_cluster_boxes", f"WITH RECURSIVE {_COMPONENTS} SELECT page, cluster, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1, count(*) AS lines FROM lines JOIN clusters USING (page, line) GROUP BY page, cluster")
def a21(s, d):
    return la.cluster_boxes(lines(s, d), la.clusters(lines(s, d), la.near_pairs(lines(s, d), 30)))


@query("g04_hulls")
def g04(s, d):
    return la.cluster_hulls(lines(s, d), la.clusters(lines(s, d), la.near_pairs(lines(s, d), 30)))


@query("a20_merged_lines")
def a20(s, d):
    return la.merged_lines(lines(s, d)).select("page", "line", "members", F.transform("points", lambda p: F.struct(F.round(p["x"], 4).alias("x"), F.round(p["y"], 4).alias("y"))).alias("points"), "h")


@query("w05_gap_clusters", f"WITH {LINES} SELECT page, line, sum(new) OVER (PARTITION BY page ORDER BY y, line)::BIGINT AS cluster FROM (SELECT page, line, y, CASE WHEN y - lag(y) OVER (PARTITION BY page ORDER BY y, line) > 100 THEN 1 ELSE 0 END AS new FROM lines)")
def w05(s, d):
    return la.gap_clusters(lines(s, d), ["page"], "y", 100, "line").select("page", "line", "cluster")


@query("w06_step_sums", f"WITH {LINES} SELECT page, coalesce(sum(abs(q - x)), 0)::BIGINT AS total FROM (SELECT page, x, lead(x) OVER (PARTITION BY page ORDER BY x, line) AS q FROM lines) GROUP BY page")
def w06(s, d):
    return la.step_sums(lines(s, d), ["page"], "x", ["x", "line"])


def cells(s, d):
    return frames(s, d).select("line", F.posexplode("scores").alias("t", "f")).select("line", "t", F.posexplode("f").alias("k", "v"))


@query("w07_suppressed", f"WITH {CELLS} SELECT line, t::INT AS t, k::INT AS k, round(CASE WHEN v = max(v) OVER (PARTITION BY line, k ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) THEN v ELSE 0 END, 6) AS v FROM cells")
def w07(s, d):
    return la.suppressed(cells(s, d), ["line", "k"], "t", "v").withColumn("v", F.round("v", 6))


@query("w08_smoothed", f"WITH {CELLS} SELECT line, t::INT AS t, k::INT AS k, round(avg(v) OVER (PARTITION BY line, k ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS v FROM cells")
def w08(s, d):
    return la.smoothed(cells(s, d), ["line", "k"], "t", "v").withColumn("v", F.round("v", 6))


@query("w09_peaks")
def w09(s, d):
    @F.pandas_udf("array<struct<at:double,height:double>>")
    def found(v: pd.Series) -> pd.Series:
        return pd.Series([[{"at": round(a, 6), "height": round(h, 6)} for a, h in ge.peaks(np.array(x, float), 4)] for x in v])

    return table(s, d, "embeddings").select("vec_id", F.explode(found("embedding")).alias("p")).select("vec_id", "p.*")


@query("w11_arc_lengths", f"WITH {LINES}, s AS (SELECT page, line, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS d FROM lines WINDOW w AS (PARTITION BY page ORDER BY line)) SELECT page, line, round(sum(d) OVER (PARTITION BY page ORDER BY line), 4) AS along FROM s")
def w11(s, d):
    return la.arc_lengths(lines(s, d), ["page"], "line").select("page", "line", F.round("along", 4).alias("along"))


@query("w12_line_chunks", f"WITH {LINES} SELECT page, line, (c.s // 60)::INT AS chunk, c.s::BIGINT AS start, least(80, w - c.s)::BIGINT AS width FROM lines, (SELECT unnest(range(0, 400, 60)) AS s) c WHERE c.s = 0 OR (w > 80 AND c.s <= greatest(w - 21, 0))")
def w12(s, d):
    return la.line_chunks(lines(s, d), 80)


@query("o06_reading_order", f"WITH {REGIONS}, o AS (SELECT page, region, CASE WHEN region = 'b' AND page % 3 = 0 THEN 0 END AS index FROM regions) SELECT page, region, row_number() OVER (PARTITION BY page ORDER BY index NULLS LAST, region)::INT AS place FROM o")
def o06(s, d):
    r = regions(s, d).withColumn("region_pos", F.when(F.col("region") == "a", 0).otherwise(1))
    order = regions(s, d).where("region = 'b' and page % 3 = 0").select("page", "region", F.lit(0).alias("index"))
    return la.reading_order(r, order).select("page", "region", "place")


@query("s06_order_maps", f"WITH {REGIONS} SELECT page, max(CASE WHEN region = 'a' THEN 2 * (page % 5) + 1 END)::BIGINT AS a, max(CASE WHEN region = 'b' THEN page % 5 END)::BIGINT AS b FROM regions GROUP BY page")
def s06(s, d):
    rows = regions(s, d).select("page", "region", F.explode(F.sequence(F.lit(0), F.when(F.col("region") == "a", 1).otherwise(0))).alias("pos"))
    rows = rows.withColumn("index", F.when(F.col("pos") == 1, 2 * (F.col("page") % 5) + 1).otherwise(F.col("page") % 5))
    return la.order_maps(rows).select("page", F.col("reading_order")["a"].alias("a"), F.col("reading_order")["b"].alias("b"))


@query("o07_top_down", f"WITH {LINES} SELECT page, line, row_number() OVER (PARTITION BY page ORDER BY y, line)::INT AS place FROM lines")
def o07(s, d):
    return la.top_down(lines(s, d), "line").select("page", "line", "place")


@query("o08_smart_order")
def o08(s, d):
    c = la.cluster_boxes(lines(s, d), la.clusters(lines(s, d), la.near_pairs(lines(s, d), 30)))
    angles = la.rotation(lines(s, d).select("page", "line", F.col("w").cast("double").alias("dx"), ((F.col("h") - 17) / 4).alias("dy")))
    return la.smart_order(c.withColumnRenamed("cluster", "region"), angles)


@query("o09_xy_cut")
def o09(s, d):
    return la.smart_order(la.cluster_boxes(lines(s, d), la.clusters(lines(s, d), la.near_pairs(lines(s, d), 30))).withColumnRenamed("cluster", "region"))


@query("o10_order_lines", f"WITH {LINES} SELECT page, line, row_number() OVER (PARTITION BY page ORDER BY y, line)::INT AS place FROM lines")
def o10(s, d):
    return la.top_down(lines(s, d), "line").select("page", "line", "place")


@query("o11_left_to_right", f"WITH {LINES} SELECT page, line, row_number() OVER (PARTITION BY page ORDER BY x, line)::INT AS place FROM lines")
def o11(s, d):
    return la.left_to_right(lines(s, d), "line").select("page", "line", "place")


@query("o12_batches", f"WITH {LINES}, p AS (SELECT page, line, (ceil(w / 32.0) * 32)::BIGINT AS padded FROM lines) SELECT page, line, padded, ((row_number() OVER (PARTITION BY page, padded ORDER BY line) - 1) // greatest(1, 480 // padded))::BIGINT AS batch FROM p")
def o12(s, d):
    return la.batched(lines(s, d), ["page"], 480).select("page", "line", "padded", "batch")


@query("o13_sampled", f"WITH {LINES} SELECT page, line FROM lines ORDER BY md5(concat(line, '')) , line LIMIT 100")
def o13(s, d):
    """A sample of 100 lines, by a hash instead of chance."""
    return lines(s, d).orderBy(F.md5(F.col("line").cast("string")), "line").limit(100).select("page", "line")


@query("o14_annotation_order", f"WITH {LINES} SELECT page, concat(page, '-', line, '.jpg') AS key, row_number() OVER (PARTITION BY page ORDER BY line::VARCHAR)::INT AS place FROM lines")
def o14(s, d):
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("page").orderBy(F.col("line").cast("string")))
    return lines(s, d).select("page", F.concat("page", F.lit("-"), "line", F.lit(".jpg")).alias("key"), place.alias("place"))


@query("o16_best_line", f"WITH {_ASSIGNED} SELECT page, region, line FROM (SELECT a.page, a.region, a.line, l.w + l.h AS v FROM assigned a JOIN lines l USING (page, line)) QUALIFY row_number() OVER (PARTITION BY page, region ORDER BY v DESC, line) = 1")
def o16(s, d):
    return la.best_line(assigned(s, d).select("page", "region", "line").join(lines(s, d), ["page", "line"]))


@query("a22_heights", f"WITH {LINES} SELECT page, round(coalesce(quantile_cont(h - 12, 0.7) FILTER (WHERE h > 12), 1), 6) AS height FROM lines GROUP BY page")
def a22(s, d):
    return la.heights(lines(s, d).withColumn("v", F.col("h") - 12), ["page"], "v", 0.7).withColumn("height", F.round("height", 6))


@query("a23_rotation", f"WITH {LINES}, n AS (SELECT page, degrees(atan2((h - 17) / 4.0, w)) AS angle, row_number() OVER (PARTITION BY page ORDER BY sqrt(w::DOUBLE * w + ((h - 17) / 4.0) ** 2) DESC, line) AS n, count(*) OVER (PARTITION BY page) AS c FROM lines) SELECT page, round(avg(angle), 5) AS angle FROM n WHERE n <= greatest(1, c // 2) GROUP BY page")
def a23(s, d):
    v = lines(s, d).select("page", "line", F.col("w").cast("double").alias("dx"), ((F.col("h") - 17) / 4.0).alias("dy"))
    return la.rotation(v).select("page", F.round("angle", 5).alias("angle"))


@query("a28_fullest_region", f"WITH {_ASSIGNED} SELECT page, region, count(*) AS lines FROM assigned GROUP BY page, region QUALIFY row_number() OVER (PARTITION BY page ORDER BY count(*) DESC, region) = 1")
def a28(s, d):
    return la.fullest_region(assigned(s, d))


def baseline(dx: int = 0):
    at = lambda i: ge.point(F.col("x") + F.col("w") * i / 4, F.col("y") + (F.col("h") - 17) * i * i / 8.0)
    return F.transform(F.sequence(F.lit(0), F.lit(4)), at)


_BASE = f"{LINES}, pts AS (SELECT line, i::INT AS i, x + w * i / 4.0 AS px, y + (h - 17) * i * i / 8.0 AS py, h FROM lines, range(5) r(i))"


def _points(df, c: str = "p"):
    return df.select("line", F.posexplode(c).alias("i", "q")).select("line", "i", F.round("q.x", 4).alias("x"), F.round("q.y", 4).alias("y"))


@query("g01_outline", f"""WITH {_BASE}, ang AS (SELECT *, atan2(lead(py) OVER w - py, lead(px) OVER w - px) AS f, atan2(py - lag(py) OVER w, px - lag(px) OVER w) AS g FROM pts WINDOW w AS (PARTITION BY line ORDER BY i)), a AS (SELECT line, i, px, py, h, coalesce(f, g) AS f FROM ang)
SELECT line, i, round(px + 12 * sin(f), 4) AS x, round(py - 12 * cos(f), 4) AS y FROM a UNION ALL SELECT line, 9 - i, round(px - 4 * sin(f), 4), round(py + 4 * cos(f), 4) FROM a""")
def g01(s, d):
    return _points(lines(s, d).select("line", ge.outline(baseline(), F.lit(12.0), F.lit(4.0)).alias("p")))


@query("g02_resampled_straight", f"WITH {LINES} SELECT line, i::INT AS i, round(x + w * i / 9.0, 4) AS x, round(y + (h - 17) * 2.0 * i / 9.0, 4) AS y FROM lines, range(10) r(i)")
def g02(s, d):
    return _points(lines(s, d).select("line", ge.resampled_straight(baseline()).alias("p")))


@query("g02_resampled")
def g02_curved(s, d):
    return _points(lines(s, d).select("line", la.resampled_udf()(baseline()).alias("p")))


@query("g03_rotated", f"WITH {_BASE} SELECT line, i, round(500 + cos(radians(7)) * (px - 500) - sin(radians(7)) * (py - 700), 4) AS x, round(700 + sin(radians(7)) * (px - 500) + cos(radians(7)) * (py - 700), 4) AS y FROM pts")
def g03(s, d):
    return _points(lines(s, d).select("line", ge.rotated(baseline(), 7, 500, 700).alias("p")))


@query("g05_uncontained", f"WITH RECURSIVE {_COMPONENTS}, b AS (SELECT page, cluster AS id, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1 FROM lines JOIN clusters USING (page, line) GROUP BY page, cluster) SELECT page, id FROM b WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.page = b.page AND o.x0 <= b.x0 AND o.y0 <= b.y0 AND o.x1 >= b.x1 AND o.y1 >= b.y1 AND o.id <> b.id AND NOT (o.x0 = b.x0 AND o.y0 = b.y0 AND o.x1 = b.x1 AND o.y1 = b.y1 AND o.id > b.id))")
def g05(s, d):
    boxes = la.cluster_boxes(lines(s, d), la.clusters(lines(s, d), la.near_pairs(lines(s, d), 30))).withColumnRenamed("cluster", "id").drop("lines")
    return la.uncontained(boxes, ["page"]).select("page", "id")


@query("g06_quarter_turned", f"WITH {_BASE} SELECT line, i, round(CASE line % 4 WHEN 1 THEN 1000 - py WHEN 2 THEN 1000 - px WHEN 3 THEN py ELSE px END, 4) AS x, round(CASE line % 4 WHEN 1 THEN px WHEN 2 THEN 1500 - py WHEN 3 THEN 1500 - px ELSE py END, 4) AS y FROM pts")
def g06(s, d):
    return _points(lines(s, d).select("line", ge.quarter_turned(baseline(), F.col("line") % 4, F.lit(1000), F.lit(1500)).alias("p")))


@query("g13_stretched", f"WITH {_BASE} SELECT line, i + 1 AS i, round(px, 4) AS x, round(py, 4) AS y FROM pts UNION ALL SELECT line, CASE i WHEN 0 THEN 0 ELSE 6 END, round(px + CASE i WHEN 0 THEN -15 ELSE 15 END, 4), round(py, 4) FROM pts WHERE i IN (0, 4)")
def g13(s, d):
    return _points(lines(s, d).select("line", ge.stretched(baseline(), 15).alias("p")))


@query("g14_page_regions", "SELECT DISTINCT o_custkey AS page, 'r1' AS region, 0 AS x0, 0 AS y0, 1000 AS x1, 1500 AS y1 FROM orders")
def g14(s, d):
    pages = lines(s, d).select("page").distinct().withColumns({"width": F.lit(1000).cast("bigint"), "height": F.lit(1500).cast("bigint")})
    return la.page_regions(pages)


@query("k07_boxes", f"WITH {_BASE} SELECT line, round(max(py) - min(py), 4) AS height, round(max(px) - min(px), 4) AS width, round(min(py), 4) AS vpos, round(min(px), 4) AS hpos FROM pts GROUP BY line")
def k07(s, d):
    b = lines(s, d).select("line", ge.box(baseline()).alias("b"))
    return b.select("line", *(F.round(F.col(f"b.{c}"), 4).alias(c) for c in ("height", "width", "vpos", "hpos")))


@query("k05_print_space", f"WITH {_ASSIGNED} SELECT page, min(x0) AS hpos, min(y0) AS vpos, max(x1) - min(x0) AS width, max(y1) - min(y0) AS height FROM assigned GROUP BY page")
def k05(s, d):
    return assigned(s, d).groupBy("page").agg(F.min("x0").alias("hpos"), F.min("y0").alias("vpos"), (F.max("x1") - F.min("x0")).alias("width"), (F.max("y1") - F.min("y0")).alias("height"))


@query("u05_orientations", f"WITH {LINES} SELECT page, line, t.r::INT AS rot FROM lines, (VALUES (0), (1), (3)) t(r)")
def u05(s, d):
    one = lambda r: lines(s, d).select("page", "line").withColumn("rot", F.lit(r))
    return one(0).unionByName(one(1)).unionByName(one(3))


@query("s05_points", f"WITH {LINES} SELECT line, x AS x, round_even(y + 0.5, 0)::INT AS y FROM lines")
def s05(s, d):
    text = F.concat("x", F.lit(","), "y", F.lit(".5"))
    return lines(s, d).select("line", F.explode(ge.parsed_points(text)).alias("p")).select("line", "p.*")
