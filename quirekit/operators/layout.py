"""Layout operators over lines and regions of pages: filters, spatial joins, clusters, merging and reading order.

lines are (page, line, x, y, w, h), boxes whose y is the upper edge; regions are (page, region, x0, y0, x1, y1).
A page is the unit of work: joins are on the page and then on boxes, and what needs a sequence of steps runs page by page.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirekit.functions.geometry import POINTS, areas, box, clipped_many, convex_hull, resample, resample_many

#: Rows of pages that a task labels at once, at least where there are so many.
PAGE_ROWS = 20_000
#: Pairs that are clipped together.
CLIPPED = 2048


def by_pages(rows: DataFrame, order: list[str], made: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """made() of the rows, dealt by page and sorted by page and `order`, some whole pages at a time."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in it:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < PAGE_ROWS:
                continue
            code = batch.column(batch.schema.get_field_index("page")).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            if (code != code[-1]).any():
                cut = int(np.flatnonzero(code != code[-1])[-1]) + 1
                yield made(pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]).combine_chunks().to_batches()[0])
                held = [batch.slice(cut)]
        if held:
            yield made(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return rows.repartition("page").sortWithinPartitions("page", *order).mapInArrow(run, schema)


def _arrays(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names]


def _starts(batch: pa.RecordBatch, *names: str) -> np.ndarray:
    """Where groups of equal values begin, and the end of the last."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for c in names:
        code = batch.column(batch.schema.get_field_index(c)).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.append(np.flatnonzero(new), batch.num_rows)


def _lists(points: np.ndarray, count: np.ndarray) -> pa.Array:
    """Points, count of them in each list, as arrays of (x, y)."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(points[:, k])) for k in (0, 1)], ["x", "y"]))


def _points_of(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(points, count) of arrays of (x, y); a null is an empty one."""
    flat = lists.flatten()
    count = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False))).astype(np.int64)
    return np.stack([flat.field(k).to_numpy(zero_copy_only=False).astype(float) for k in (0, 1)], axis=1), count


def flattened(pages: DataFrame) -> DataFrame:
    """(page, region_pos, line_pos, line) of nested pages (page, regions: array of (lines: array))."""
    regions = pages.select("page", F.posexplode("regions").alias("region_pos", "r"))
    return regions.select("page", "region_pos", F.posexplode("r.lines").alias("line_pos", "line"))


def confident(lines: DataFrame, threshold: float) -> DataFrame:
    """The lines above the threshold; all of them if it isn't above 0. A null confidence isn't above it."""
    return lines.where(F.col("confidence") > threshold) if threshold > 0 else lines


def inner_lines(lines: DataFrame, page_width: float, margin: float = 20, ratio: float = 0.125) -> DataFrame:
    """The lines that don't hug an edge of the page within a short reach."""
    x0, x1 = F.col("x"), F.col("x") + F.col("w")
    left = (x0 < margin) & (x1 <= page_width * ratio)
    right = (x1 > page_width - margin) & (x0 >= page_width * (1 - ratio))
    return lines.where(~(left | right))


def long_pages(lines: DataFrame, threshold: float) -> DataFrame:
    """The lines of the pages whose longest line is `threshold` or more."""
    kept = lines.groupBy("page").agg(F.max("w").alias("_longest")).where(F.col("_longest") >= threshold).select("page")
    return lines.join(kept, "page", "left_semi")


def filled_regions(regions: DataFrame, assigned: DataFrame) -> DataFrame:
    """The regions that have lines."""
    return regions.join(assigned, ["page", "region"], "left_semi")


def line_filter(lines: DataFrame, page_width: float, directions: DataFrame | None = None, incomplete: bool = False, short: float | None = None) -> DataFrame:
    """The filters by flag: lines in a page's direction, lines not cut off by the page's edge, pages with long lines."""
    if directions is not None:
        lines = along(lines, directions)
    if incomplete:
        lines = inner_lines(lines, page_width)
    return lines if short is None else long_pages(lines, short)


def along(lines: DataFrame, directions: DataFrame, most: float = np.pi / 4) -> DataFrame:
    """The lines (with `angle`) within `most` of level or of their page's direction (page, direction)."""
    off = F.abs(F.col("angle") - F.coalesce("direction", F.lit(0.0))) % (2 * np.pi)
    return lines.join(directions, "page", "left").where((F.abs("angle") <= most) | (F.least(off, 2 * np.pi - off) <= most)).drop("direction")


def numbered(lines: DataFrame) -> DataFrame:
    """lines with line_pos, their place on the page by id."""
    return lines.withColumn("line_pos", (F.row_number().over(W.partitionBy("page").orderBy("line")) - 1).cast("int"))


def assigned(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """(page, region, id, line, x0, y0, x1, y1): each line's part in each region that it overlaps, with an id of region and number; a line may be in several, or none."""
    pairs = numbered(lines).join(regions.select("page", "region", F.col("x0").alias("rx0"), F.col("y0").alias("ry0"), F.col("x1").alias("rx1"), F.col("y1").alias("ry1")), "page")
    pairs = pairs.where((F.col("x") < F.col("rx1")) & (F.col("x") + F.col("w") > F.col("rx0")) & (F.col("y") < F.col("ry1")) & (F.col("y") + F.col("h") > F.col("ry0")))
    return pairs.select(
        "page", "region", F.format_string("%s-l%03d", "region", F.col("line_pos") + 1).alias("id"), "line", F.greatest("x", "rx0").alias("x0"), F.greatest("y", "ry0").alias("y0"),
        F.least(F.col("x") + F.col("w"), "rx1").alias("x1"), F.least(F.col("y") + F.col("h"), "ry1").alias("y1"),
    )


def clipped_parts(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """(page, region, line, part, area): what of each line's edge (page, line, edge) lies in each region's (page, region, edge), a convex polygon, where that is more than nothing.

    Pairs are those whose boxes overlap; only they are clipped."""
    boxed = lambda df, *keys: df.select(*keys, "edge", box(F.col("edge")).alias("b"))
    r = boxed(regions, "page", "region").withColumnsRenamed({"edge": "region_edge", "b": "rb"})
    apart = lambda pos, size: (F.col(f"b.{pos}") < F.col(f"rb.{pos}") + F.col(f"rb.{size}")) & (F.col(f"b.{pos}") + F.col(f"b.{size}") > F.col(f"rb.{pos}"))
    pairs = boxed(lines, "page", "line").join(r, "page").where(apart("hpos", "width") & apart("vpos", "height"))

    def part(edges: pa.Array, of: pa.Array) -> pa.Array:
        points, count = _points_of(edges)
        corners, size = _points_of(of)
        first = np.concatenate([[0], np.cumsum(size)])
        known: dict[bytes, int] = {}
        hulls: list[np.ndarray] = []
        which = np.zeros(len(count), np.int64)
        for i, (p, q) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            key = corners[p:q].tobytes()
            if key not in known:
                known[key] = len(hulls)
                hulls.append(convex_hull(corners[p:q]).reshape(-1, 2))
            which[i] = known[key]
        points, count = clipped_many(points, count, np.concatenate([*hulls, np.zeros((1, 2))]), np.array([len(h) for h in hulls], np.int64), which)
        return pa.StructArray.from_arrays([_lists(points, count), pa.array(areas(points, count))], ["part", "area"])

    @F.arrow_udf("struct<part:array<struct<x:double,y:double>>,area:double>")
    def clip(edge: pa.Array, region: pa.Array) -> pa.Array:
        return pa.concat_arrays([part(edge.slice(at, CLIPPED), region.slice(at, CLIPPED)) for at in range(0, max(1, len(edge)), CLIPPED)])

    return pairs.select("page", "region", "line", clip("edge", "region_edge").alias("c")).select("page", "region", "line", "c.part", "c.area").where("area > 0")


def grid_overlaps(a: DataFrame, b: DataFrame, cell: float, by: list[str]) -> DataFrame:
    """Pairs of boxes (id, x0, y0, x1, y1) of two tables that overlap within the keys `by`, as (by, id, other): by the cells of a grid, so pages of many boxes need no quadratic join. A pair is given in the cell of its overlap's corner only."""
    cells = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    spread = lambda df: df.withColumn("gx", F.explode(cells("x0", "x1"))).withColumn("gy", F.explode(cells("y0", "y1")))
    other = spread(b).select(*by, "gx", "gy", *(F.col(c).alias(f"_{c}") for c in ("id", "x0", "y0", "x1", "y1")))
    both = spread(a).join(other, [*by, "gx", "gy"]).where("x0 < _x1 and x1 > _x0 and y0 < _y1 and y1 > _y0")
    corner = (F.floor(F.greatest("x0", "_x0") / cell) == F.col("gx")) & (F.floor(F.greatest("y0", "_y0") / cell) == F.col("gy"))
    return both.where(corner).select(*by, "id", F.col("_id").alias("other"))


def row_pairs(lines: DataFrame) -> DataFrame:
    """(page, line, other) of lines in one row: vertical extents overlap by over 0.7 of the lower height, neither is within the other's reach along x, and the gap is below twice the lower height."""
    reach = 2 * F.col("h")  # the gap of a pair is below twice the lower height, so one of the two boxes, grown by its own, meets the other
    grown = lines.select("page", F.col("line").alias("id"), (F.col("x") - reach).alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w") + reach).alias("x1"), (F.col("y") + F.col("h")).alias("y1"))
    near = grid_overlaps(grown, grown, 256.0, ["page"]).where("id < other").select("page", F.col("id").alias("line"), "other")
    b = lines.select("page", F.col("line").alias("other"), *(F.col(c).alias(f"_{c}") for c in ("x", "y", "w", "h")))
    low = F.least("h", "_h")
    overlap = F.least(F.col("y") + F.col("h"), F.col("_y") + F.col("_h")) - F.greatest("y", "_y")
    inside = ((F.col("x") < F.col("_x")) & (F.col("x") + F.col("w") > F.col("_x") + F.col("_w"))) | ((F.col("_x") < F.col("x")) & (F.col("_x") + F.col("_w") > F.col("x") + F.col("w")))
    gap = F.greatest("x", "_x") - F.least(F.col("x") + F.col("w"), F.col("_x") + F.col("_w"))
    return near.join(lines, ["page", "line"]).join(b, ["page", "other"]).where((overlap > 0.7 * low) & ~inside & (gap < 2 * low)).select("page", "line", "other")


def near_pairs(lines: DataFrame, by: float) -> DataFrame:
    """(page, line, other) of lines whose boxes, grown by `by` on each side, overlap."""
    grown = lines.select("page", F.col("line").alias("id"), (F.col("x") - by).alias("x0"), (F.col("y") - by).alias("y0"), (F.col("x") + F.col("w") + by).alias("x1"), (F.col("y") + F.col("h") + by).alias("y1"))
    return grid_overlaps(grown, grown, 256.0, ["page"]).where("id < other").withColumnRenamed("id", "line")


def least_members(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of n nodes' connected component, of edges between a and b: labels fall along edges and are followed to their ends, until none changes."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            break
        label = new
    return label


def clusters(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """(page, line, cluster): connected components of the pairs on each page, named by their least line.

    Lines and pairs are dealt by page and sorted; a task labels all pages of a batch at once."""

    def labelled(page: pa.Array, line: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
        code = page.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        node = line == other
        order = np.lexsort((line[node], code[node]))
        pages, ids = code[node][order], line[node][order]
        # nodes are in the order of (page, line): places of edges' ends are looked up by page and rank of the line
        names, rank = np.unique(np.concatenate([line, other]), return_inverse=True)
        rank = rank.ravel()
        key = pages.astype(np.int64) * len(names) + np.searchsorted(names, ids)
        ends = [np.searchsorted(key, code[~node].astype(np.int64) * len(names) + r[~node]) for r in (rank[: len(line)], rank[len(line) :])]
        label = least_members(len(ids), *ends)
        return pa.RecordBatch.from_arrays([page.take(pa.array(np.flatnonzero(node)[order])), pa.array(ids), pa.array(ids[label])], ["page", "line", "cluster"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in it:
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            if not table.num_rows:
                continue
            held = table.to_batches()[0]
            code = held.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            cut = int(np.flatnonzero(code != code[-1])[-1]) + 1 if (code != code[-1]).any() else 0
            if cut >= PAGE_ROWS:
                yield labelled(held.column(0).slice(0, cut), *(held.column(i).slice(0, cut).to_numpy(zero_copy_only=False) for i in (1, 2)))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield labelled(held.column(0), *(held.column(i).to_numpy(zero_copy_only=False) for i in (1, 2)))

    kind, line = (lines.schema[c].dataType.simpleString() for c in ("page", "line"))
    both = lines.select("page", "line", F.col("line").alias("other")).distinct().union(pairs.select("page", "line", "other").where("line <> other"))
    return both.repartition("page").sortWithinPartitions("page").mapInArrow(run, f"page {kind}, line {line}, cluster {line}")


def cluster_boxes(lines: DataFrame, of: DataFrame) -> DataFrame:
    """(page, cluster, x0, y0, x1, y1, lines) around each cluster's lines."""
    return lines.join(of, ["page", "line"]).groupBy("page", "cluster").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"), F.count("*").alias("lines"))


def cluster_hulls(lines: DataFrame, of: DataFrame) -> DataFrame:
    """(page, cluster, hull): the convex hull of each cluster's corners, as points."""

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = _starts(batch, "page", "cluster")
        x, y, w, h = (v.astype(float) for v in _arrays(batch, "x", "y", "w", "h"))
        corners = np.stack([np.stack([a, b], 1) for a in (x, x + w) for b in (y, y + h)], 1)
        hulls = [corners[i, [0, 2, 3, 1]] if j == i + 1 and w[i] > 0 and h[i] > 0 else convex_hull(corners[i:j].reshape(-1, 2)).reshape(-1, 2) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
        keys = [batch.column(batch.schema.get_field_index(c)).take(pa.array(at[:-1])) for c in ("page", "cluster")]
        return pa.RecordBatch.from_arrays([*keys, _lists(np.concatenate(hulls), np.array([len(p) for p in hulls]))], ["page", "cluster", "hull"])

    page, line = (lines.schema[c].dataType.simpleString() for c in ("page", "line"))
    rows = lines.join(of, ["page", "line"]).select("page", "cluster", "x", "y", "w", "h")
    return by_pages(rows, ["cluster"], made, f"page {page}, cluster {line}, hull array<struct<x:double,y:double>>")


def merged_lines(lines: DataFrame, n_points: int = 10) -> DataFrame:
    """(page, line, members, points, h): lines of a row merged until no more are: each joins the first group that claims it, in the order of (y, line); heights are the largest of a group, points run along its lower edges, resampled."""

    def row(y, h, members: list, points: list[tuple]) -> tuple:
        xs, ys = [p[0] for p in points], [p[1] for p in points]
        return y, h, members, points, min(xs), max(xs), (ys[0] + ys[1]) / 2 if len(ys) == 2 else float(np.mean(ys))

    def page_of(rows: list[tuple]) -> list[tuple]:
        while True:
            left, out = rows, []
            while left:
                group, rest = [left[0]], []
                for r in left[1:]:
                    (group if _same_row(group[0], r) else rest).append(r)
                left = rest
                if len(group) == 1:
                    out.append(group[0])
                    continue
                points = [tuple(p) for p in resample(np.array(sorted(p for g in group for p in g[3])), n_points)]
                out.append(row(max(g[0] for g in group), max(g[1] for g in group), sorted(m for g in group for m in g[2]), points))
            if len(out) == len(rows):
                return out
            rows = out

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = _starts(batch, "page")
        one = [row(y + h, h, [line], [(x, y + h), (x + w, y + h)]) for line, x, y, w, h in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("line", "x", "y", "w", "h")))]
        pages = [page_of(one[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
        rows = [r for p in pages for r in p]
        page = batch.column(batch.schema.get_field_index("page")).take(pa.array(np.repeat(at[:-1], [len(p) for p in pages])))
        kind = batch.schema.field("line").type
        points = _lists(np.array([p for r in rows for p in r[3]], float), np.array([len(r[3]) for r in rows]))
        return pa.RecordBatch.from_arrays([page, pa.array([r[2][0] for r in rows], kind), pa.array([r[2] for r in rows], pa.list_(kind)), points, pa.array([float(r[1]) for r in rows])], ["page", "line", "members", "points", "h"])

    page, line = (lines.schema[c].dataType.simpleString() for c in ("page", "line"))
    return by_pages(lines.select("page", "line", "x", "y", "w", "h"), ["y", "line"], made, f"page {page}, line {line}, members array<{line}>, points array<struct<x:double,y:double>>, h double")


def _same_row(a: tuple, b: tuple) -> bool:
    """Whether two rows (.., h, .., .., least x, largest x, mean y) are one."""
    (_, ah, _, _, a0, a1, ay), (_, bh, _, _, b0, b1, by) = a, b
    low = min(ah, bh)
    if min(ay, by) - max(ay - ah, by - bh) <= 0.7 * low:
        return False
    inside = (a0 < b0 and a1 > b1) or (b0 < a0 and b1 > a1)
    return not inside and max(a0, b0) - min(a1, b1) < 2 * low


def resampled_udf(n: int = 10):
    """resample() of a column of baselines, those of equally many points together; NULL where a baseline is."""

    @F.arrow_udf(POINTS)
    def run(v: pa.Array) -> pa.Array:
        points, count = _points_of(v)
        first = np.cumsum(count) - count
        out, size = np.zeros((len(count), n, 2)), np.where(count > 0, n, 0)
        for c in np.unique(count[count > 0]).tolist():
            own = np.flatnonzero(count == c)
            for at in range(0, len(own), 1024):
                some = own[at : at + 1024]
                out[some] = resample_many(points[first[some][:, None] + np.arange(c)], n)
        lists = _lists(out[count > 0].reshape(-1, 2), size)
        return pc.if_else(v.is_null(), pa.scalar(None, lists.type), lists)

    return run


def gap_clusters(values: DataFrame, keys: list[str], value: str, eps: float, tie: str) -> DataFrame:
    """values with `cluster`, counted from 0 along the sorted values: a new one begins after a gap of more than eps."""
    over = W.partitionBy(*keys).orderBy(value, tie)
    gap = F.col(value) - F.lag(value).over(over)
    return values.withColumn("_new", F.when(gap > eps, 1).otherwise(0)).withColumn("cluster", F.sum("_new").over(over.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def step_sums(values: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """(keys, total): the sum of the differences of neighbours, without sign; 0 for one value."""
    ahead = F.lead(value).over(W.partitionBy(*keys).orderBy(*order))
    return values.withColumn("_d", F.abs(ahead - F.col(value))).groupBy(*keys).agg(F.coalesce(F.sum("_d"), F.lit(0)).alias("total"))


def suppressed(cells: DataFrame, keys: list[str], order: str, value: str, reach: int = 2) -> DataFrame:
    """cells with `value` set to 0 unless it is the largest within `reach` cells."""
    over = W.partitionBy(*keys).orderBy(order).rowsBetween(-reach, reach)
    return cells.withColumn(value, F.when(F.col(value) == F.max(value).over(over), F.col(value)).otherwise(F.lit(0.0)))


def smoothed(cells: DataFrame, keys: list[str], order: str, value: str, reach: int = 1) -> DataFrame:
    """cells with the mean of the cells within `reach`."""
    return cells.withColumn(value, F.avg(value).over(W.partitionBy(*keys).orderBy(order).rowsBetween(-reach, reach)))


def arc_lengths(points: DataFrame, keys: list[str], order: str) -> DataFrame:
    """points (x, y) with `along`, the length of the path up to each."""
    over = W.partitionBy(*keys).orderBy(order)
    step = F.coalesce(F.sqrt(F.pow(F.col("x") - F.lag("x").over(over), 2) + F.pow(F.col("y") - F.lag("y").over(over), 2)), F.lit(0.0))
    return points.withColumn("_d", step).withColumn("along", F.sum("_d").over(over.rowsBetween(W.unboundedPreceding, 0))).drop("_d")


def line_chunks(lines: DataFrame, widest: int) -> DataFrame:
    """(page, line, chunk, start, width): lines wider than that cut into overlapping parts that begin 3/4 of it apart."""
    step = widest - widest // 4
    starts = F.when(F.col("w") <= widest, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("w").cast("bigint") - widest // 4 - 1, F.lit(0).cast("bigint")), F.lit(step).cast("bigint")))
    return lines.select("page", "line", "w", F.posexplode(starts).alias("chunk", "start")).select("page", "line", "chunk", "start", F.least(F.lit(widest).cast("bigint"), F.col("w") - F.col("start")).alias("width"))


def reading_order(regions: DataFrame, order: DataFrame) -> DataFrame:
    """regions with `place`, from 1: by their index in `order` (page, region, index), those without one last, as they came (region_pos)."""
    over = W.partitionBy("page").orderBy(F.asc_nulls_last("index"), "region_pos")
    return regions.join(order, ["page", "region"], "left").withColumn("place", F.row_number().over(over)).drop("index")


def order_maps(order: DataFrame) -> DataFrame:
    """(page, reading_order): region to index; of repeated ones the last `pos` counts."""
    last = order.groupBy("page", "region").agg(F.max_by("index", "pos").alias("index"))
    return last.groupBy("page").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("region", "index")))).alias("reading_order"))


def top_down(boxes: DataFrame, tie: str) -> DataFrame:
    """boxes with `place`, from 1: by upper edge."""
    return boxes.withColumn("place", F.row_number().over(W.partitionBy("page").orderBy("y", tie)))


def left_to_right(boxes: DataFrame, tie: str) -> DataFrame:
    return boxes.withColumn("place", F.row_number().over(W.partitionBy("page").orderBy("x", tie)))


def xy_cut(boxes: list[tuple], least: float = 0.1) -> list[int]:
    """The reading order of boxes (x0, y0, x1, y1): grouped by overlap along y, each group then along x, in turn, until the groups are single; groups that neither axis splits are sorted along the axis on which they are spread more."""

    def groups(ids: list[int], axis: int) -> list[list[int]]:
        lo, hi = axis, axis + 2
        out: list[tuple] = []
        near: list[tuple] = []  # groups that a later box may meet: the first place and member, how far they reach, the members
        for i in sorted(ids, key=lambda i: (boxes[i][lo], i)):
            a = boxes[i]
            first, far, own = (a[lo], i), a[hi], [i]
            still = []
            for g in near:
                if g[1] < a[lo]:
                    out.append(g)
                elif any(meet(a, boxes[j], lo, hi) for j in g[2]):
                    first, far, own = min(first, g[0]), max(far, g[1]), g[2] + own
                else:
                    still.append(g)
            near = [*still, (first, far, own)]
        return [g[2] for g in sorted(out + near)]

    def meet(a, b, lo, hi) -> bool:
        if a[lo] > b[hi] or b[lo] > a[hi]:
            return False
        size = min(abs(a[lo] - b[hi]), abs(b[lo] - a[hi]))
        return all(size > least * (r[hi] - r[lo]) for r in (a, b))

    def order(ids: list[int], axis: int, stuck: bool) -> list[int]:
        if len(ids) == 1:
            return ids
        parts = groups(ids, axis)
        if len(parts) == 1:
            if stuck:
                spread = [sum(abs(b - a) for a, b in zip(v, v[1:])) for v in (sorted(boxes[i][k] for i in ids) for k in (0, 1))]
                k = 0 if spread[0] > spread[1] else 1
                return sorted(ids, key=lambda i: (boxes[i][k], i))
            return order(ids, 1 - axis, True)
        return [i for p in parts for i in order(p, 1 - axis, False)]

    return order(list(range(len(boxes))), 1, False) if boxes else []


def smart_order(regions: DataFrame, angles: DataFrame | None = None, least: float = 0.1) -> DataFrame:
    """(page, region, place): xy_cut() of each page's boxes, turned back by the page's angle in degrees (page, angle) first."""

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = _starts(batch, "page")
        angle, x0, y0, x1, y1 = (v.astype(float) for v in _arrays(batch, "angle", "x0", "y0", "x1", "y1"))
        turn = np.repeat(np.radians(angle[at[:-1]]), np.diff(at))
        c, s = np.cos(-turn), np.sin(-turn)
        px, py = ([f(x, y) for x in (x0, x1) for y in (y0, y1)] for f in (lambda x, y: x * c - y * s, lambda x, y: x * s + y * c))
        boxes = list(zip(*(f(v, axis=0).tolist() for f, v in ((np.min, px), (np.min, py), (np.max, px), (np.max, py)))))
        place = np.empty(batch.num_rows, np.int32)
        for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
            place[i + np.array(xy_cut(boxes[i:j], least))] = np.arange(1, j - i + 1)
        return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in ("page", "region")), pa.array(place)], ["page", "region", "place"])

    regions = regions.withColumn("angle", F.lit(0.0)) if angles is None else regions.join(angles, "page", "left").fillna(0.0, ["angle"])
    page, region = (regions.schema[c].dataType.simpleString() for c in ("page", "region"))
    return by_pages(regions.select("page", "region", "x0", "y0", "x1", "y1", "angle"), ["region"], made, f"page {page}, region {region}, place int")


def rotation(lines: DataFrame) -> DataFrame:
    """(page, angle): the mean angle in degrees of the longer half of each page's lines (dx, dy)."""
    over = W.partitionBy("page").orderBy(F.desc(F.sqrt(F.pow("dx", F.lit(2.0)) + F.pow("dy", F.lit(2.0)))), "line")
    n = F.count("*").over(W.partitionBy("page"))
    half = lines.withColumn("_n", F.row_number().over(over)).withColumn("_all", n).where(F.col("_n") <= F.greatest(F.lit(1), F.floor(F.col("_all") / 2)))
    return half.groupBy("page").agg(F.avg(F.degrees(F.atan2("dy", "dx"))).alias("angle"))


def batched(lines: DataFrame, keys: list[str], budget: int, pad: int = 32) -> DataFrame:
    """lines with `batch` by width, widest first, padded to multiples of `pad`: batches hold as many lines as fit the budget at their first line's width, counted by equal widths."""
    padded = (F.ceil(F.col("w") / pad) * pad).cast("bigint")
    each = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("padded")))
    place = F.row_number().over(W.partitionBy(*keys, "padded").orderBy("line")) - 1
    return lines.withColumn("padded", padded).withColumn("batch", F.floor(place / each).cast("bigint"))


def uncontained(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """The boxes (id, x0, y0, x1, y1) that lie in no other of their keys; of equal ones the least id stays."""
    b = boxes.select(*keys, *(F.col(c).alias(f"_{c}") for c in ("id", "x0", "y0", "x1", "y1")))
    a = boxes.alias("a")
    within = [a[k] == b[k] for k in keys] + [F.expr("_x0 <= x0 and _y0 <= y0 and _x1 >= x1 and _y1 >= y1 and _id <> id and not (_x0 = x0 and _y0 = y0 and _x1 = x1 and _y1 = y1 and _id > id)")]
    cond = within[0]
    for c in within[1:]:
        cond = cond & c
    return a.join(b, cond, "left_anti")


def best_line(lines: DataFrame) -> DataFrame:
    """(page, region, line): the line of each region with the largest sum of length and ascender, the least id at a tie."""
    return lines.groupBy("page", "region").agg(F.max_by("line", F.struct(F.col("w") + F.col("h"), -F.col("line"))).alias("line"))


def fullest_region(assigned_lines: DataFrame) -> DataFrame:
    """(page, region, lines): the region of each page with the most lines, the first at a tie."""
    n = assigned_lines.groupBy("page", "region").agg(F.count("*").alias("lines"))
    return n.groupBy("page").agg(F.min_by(F.struct("region", "lines"), F.struct(-F.col("lines"), "region")).alias("s")).select("page", "s.*")


def heights(cells: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """(keys, height): the percentile of the values above 0, 1 where there is none."""
    return cells.groupBy(*keys).agg(F.coalesce(F.percentile(F.when(F.col(value) > 0, F.col(value)), share), F.lit(1.0)).alias("height"))


def page_regions(pages: DataFrame) -> DataFrame:
    """One region, r1, as large as its page, for each page (page, width, height)."""
    zero = F.lit(0).cast("bigint")
    return pages.select("page", F.lit("r1").alias("region"), zero.alias("x0"), zero.alias("y0"), F.col("width").alias("x1"), F.col("height").alias("y1"))
