"""What made queries grow faster than their tables: work done once and not for each element, bounded memory, and the same results as the plain definitions."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quirekit.functions import arabic as ar
from quirekit.functions import confusion as cn
from quirekit.functions import geometry as ge
from quirekit.functions import sequence as sq
from quirekit.operators import evaluation as ev
from quirekit.operators import layout as la


def test_outline_computes_its_baseline_once(spark):
    """A computed baseline was computed again for each coordinate of each point of both sides."""
    made = F.transform(F.sequence(F.lit(0), F.col("id").cast("int") + 3), lambda i: ge.point(i, i))
    df = spark.range(2).select(ge.outline(made, F.lit(2.0), F.lit(2.0)).alias("p"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("sequence(") == 1
    assert [len(r.p) for r in df.collect()] == [8, 10]


def test_unit_costs_against_tables(monkeypatch):
    """Paths and distances by bits are those of the whole table, ties and the filling of large tables in blocks included."""
    rng = random.Random(1)
    for bits in (sq.KEPT_BITS, 300, 1):
        monkeypatch.setattr(sq, "KEPT_BITS", bits)
        for t in range(300):
            k = rng.choice([2, 3, 8])
            a = [rng.randrange(k) for _ in range(rng.randrange(0, 30))]
            b = [rng.randrange(k) for _ in range(rng.randrange(0, 30))] if t % 2 else [x if rng.random() < 0.8 else rng.randrange(k) for x in a if rng.random() < 0.9]
            ends, moves = sq._table(a, b, 1, 1, 1)
            codes = sq._codes(a, b)
            steps = sq.unit_path(*codes)
            assert steps.tolist() == sq._walk(moves, len(a), len(b)) == sq.path(a, b)
            assert sq.unit_distance(*codes) == sq.path_cost(*codes, steps) == ends[-1]


def test_substrings_against_tables():
    """Each pair filled a table in numpy, which took most of the time."""
    rng = random.Random(2)
    for _ in range(600):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(0, 25))] for _ in range(2))
        long, short = (a, b) if len(a) >= len(b) else (b, a)
        ends, moves = sq._table(long, short, 1, 1, 1, free_start=True)
        assert sq.unit_ends(*sq._codes(long, short))[0] == ends.tolist() and sq.substring_distance(a, b) == ends.min()
        end = int(np.flatnonzero(ends == ends.min())[-1])
        steps = sq._walk(moves, end, len(short), stop_row=True)
        lead = end - sum(s != sq.TARGET for s in steps)
        assert sq.substring_path(long, short) == [sq.SOURCE] * lead + steps + [sq.SOURCE] * (len(long) - end)


def peak(f) -> float:
    """The most MB of Python that f takes."""
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_alignments_keep_bits_not_tables(monkeypatch):
    """The table of one pair of long lines took a byte for each cell, and eight for some of its rows."""
    monkeypatch.setattr(sq, "KEPT_BITS", 1 << 22)
    a = np.arange(4000) % 37
    b = np.where(np.arange(4000) % 5 == 0, 40, a)
    assert peak(lambda: sq.many([a], [b])) < 12


def test_whole_texts_against_tables(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("ab cé😀") for _ in range(n))
    rows = [(i, text(i), text(50 - i // 2)) for i in range(60)] + [(60, None, "a"), (61, "", "a b")]
    got = spark.createDataFrame(rows, "i int, x string, y string").select("i", sq.text_distance_udf()("x", "y").alias("c"), sq.word_distance_udf()("x", "y").alias("w")).collect()
    words = lambda t: [w for w in t.split(" ") if w]
    for (_, x, y), r in zip(rows, sorted(got)):
        assert (r.c, r.w) == ((None, None) if x is None else (sq.distance(x, y), sq.distance(words(x), words(y))))


def test_substring_alignments_are_made_in_parts(spark):
    """Ten thousand rows were held as a dict for each pair of words, over 230 bytes each, before they went back."""
    words = [f"w{i % 11}" for i in range(20)]
    a, b = pa.array([words] * 3000, pa.list_(pa.string())), pa.array([words[3:9]] * 3000, pa.list_(pa.string()))
    made = sq.substring_alignment_udf().func
    assert peak(lambda: made(a, b)) < 12
    assert [(p["src"], p["tgt"]) for p in made(a, b)[2999].as_py()] == sq.substring_alignment(words, words[3:9])


def test_ligature_maps_are_made_of_batches(spark):
    """A list for each glyph of all rows of a batch, over 100 bytes each, was held in Python."""
    texts = ["ﻻabﷲ" * 25, None, "", "x"] * 500
    made = ar.ligature_map_udf().func
    assert peak(lambda: made(pa.array(texts))) < 12
    assert made(pa.array(texts)).slice(0, 4).to_pylist() == [None if t is None else ar.ligature_map(t) for t in texts[:4]]


def test_stitched_against_each_overlap(spark):
    """Each overlap of two parts was measured six times over, by a distance of its own for each length."""
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abé") for _ in range(n))
    whole = [text(rng.choice([0, 1, 7, 30, 90])) + text(5) for _ in range(40)]
    rows = [(i, k, t[k * 9 : k * 9 + 14] if i % 8 else t) for i, t in enumerate(whole) for k in range(4)] + [(40, 0, "a"), (40, 1, None), (41, 0, "only")]
    df = ev.stitched(spark.createDataFrame(rows, "i int, o int, text string"), ["i"], "o")
    assert "levenshtein" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = dict(df.collect())
    for i in range(40):
        left, *parts = [t for j, _, t in rows if j == i]
        for right in parts:
            tried = [(sq.distance(left[-n:], right[:n]) / n, n) for n in range(1, min(len(left), len(right)) + 1)]
            n = min(tried)[1] if tried and min(tried)[0] < 1 else 0
            left = left[: len(left) - n // 2] + right[n - n // 2 :]
        assert got[i] == left
    assert got[40] is None and got[41] == "only"


def test_report_takes_no_table_of_whole_texts(spark):
    """Whole texts were compared cell by cell, by the square of their length."""
    df = ev.report(spark.createDataFrame([(1, "a b  c", "a x c"), (2, "", "q"), (3, "ab", "")], "file int, ref string, hyp string"))
    assert "levenshtein" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.file_name, r.cer, r.wer) for r in df.collect()) == [("1", 0.2, round(1 / 3, 6)), ("2", 0.0, 0.0), ("3", 1.0, 1.0)]


def test_pages_are_made_together(spark):
    """Pages went to Python one by one, as a pandas frame and a call each; that took most of the time."""
    lines = spark.createDataFrame([(p, i, (i * 37) % 90, (i * 53) % 60, 20, 10) for p in range(3) for i in range(9)], "page int, line long, x long, y long, w long, h long")
    of = la.clusters(lines, la.near_pairs(lines, 1))
    made = [la.cluster_hulls(lines, of), la.merged_lines(lines), la.smart_order(la.cluster_boxes(lines, of).withColumnRenamed("cluster", "region"))]
    for df in made:
        assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().optimizedPlan().toString()
    hulls, merged, order = (df.collect() for df in made)
    at = {(r.page, r.line): r.cluster for r in of.collect()}
    own: dict = {}
    for r in lines.collect():
        own.setdefault((r.page, at[r.page, r.line]), []).extend((a, b) for a in (r.x, r.x + r.w) for b in (r.y, r.y + r.h))
    assert {(r.page, r.cluster): [tuple(p) for p in r.hull] for r in hulls} == {k: [tuple(p) for p in ge.convex_hull(np.array(v))] for k, v in own.items()}
    assert sorted((r.page, m) for r in merged for m in r.members) == sorted(at) and all(len(r.points) == (2 if len(r.members) == 1 else 10) for r in merged)
    for page in range(3):
        ids = sorted(c for p, c in own if p == page)
        boxes = [(min(x for x, _ in v), min(y for _, y in v), max(x for x, _ in v), max(y for _, y in v)) for v in (own[page, c] for c in ids)]
        assert [r.region for r in sorted((r for r in order if r.page == page), key=lambda r: r.place)] == [ids[i] for i in la.xy_cut(boxes)]


def test_pages_at_the_edges_of_batches(spark, monkeypatch):
    monkeypatch.setattr(la, "PAGE_ROWS", 4)
    rows = [(p, p * 10 + i, i * 50, 0, 20, 10) for p in range(20) for i in range(p % 7 + 1)]
    lines = spark.createDataFrame(rows, "page int, line long, x long, y long, w long, h long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = la.merged_lines(lines).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.page, m) for r in got for m in r.members) == sorted((r[0], r[1]) for r in rows)


def test_xy_cut_meets_only_what_is_near():
    """Each box was compared with all before it, also in a column of boxes one below the other."""
    looked = []

    class Box(tuple):
        def __getitem__(self, i):
            looked.append(i)
            return tuple.__getitem__(self, i)

    assert la.xy_cut([Box((0, 10 * i, 5, 10 * i + 9)) for i in range(400)]) == list(range(400))
    assert len(looked) < 400 * 40


def test_polygons_clipped_together():
    """Each pair was clipped by itself, with a hull of its region computed anew."""
    rng = np.random.default_rng(4)
    lines = [ge.convex_hull(rng.uniform(0, 60, (6, 2))) for _ in range(40)] + [np.array([(0, 0), (9, 9.0)]), np.zeros((0, 2))]
    hulls = [ge.convex_hull(rng.uniform(0, 60, (5, 2))) for _ in range(5)]
    which = np.arange(len(lines)) % 5
    points, count = ge.clipped_many(np.concatenate(lines), np.array([len(p) for p in lines]), np.concatenate(hulls), np.array([len(p) for p in hulls]), which)
    at = np.concatenate([[0], np.cumsum(count)])
    for i, (p, h) in enumerate(zip(lines, which)):
        want = ge.clipped(p, hulls[h])
        assert np.array_equal(points[at[i] : at[i + 1]], want)
        assert abs(ge.areas(points, count)[i] - ge.area(want)) < 1e-9


def test_baselines_resampled_together():
    """A parabola was fitted to each baseline by itself."""
    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 5):
        p = np.concatenate([rng.uniform(0, 99, (20, n, 2)), np.repeat(rng.uniform(0, 9, (3, 1, 2)), n, axis=1), np.stack([np.full((2, n), 3.0), rng.uniform(0, 99, (2, n))], axis=2)])
        assert np.allclose(ge.resample_many(p, 7), [ge.resample(q, 7) for q in p], atol=1e-7)


def test_networks_fill_no_tables(monkeypatch):
    """Each hypothesis filled a table in numpy, a row of a few cells at a time."""
    monkeypatch.setattr(sq, "_table", None)
    bag = [("view", -1.0, None), ("views", -1.0, -1.0), ("vie", -2.0, None)] * 3
    got = cn.produced(bag)
    assert cn.best_text(got) == "view" and all(abs(sum(p.values()) - 1) < 1e-9 for p in got)
