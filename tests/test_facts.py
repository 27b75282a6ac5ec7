"""Literal facts about the functions: alignments, decoders, forced alignment, confusion networks, geometry, Arabic text."""

import math
import random

import numpy as np
import pytest
from quirekit.functions import arabic as ar
from quirekit.functions import confusion as cn
from quirekit.functions import ctc
from quirekit.functions import geometry as ge
from quirekit.functions import sequence as sq
from quirekit.operators import layout as la

ABC = ["a", "b", "c", ""]


@pytest.mark.parametrize(("src", "tgt", "cost"), [([1, 2, 3], [1, -1, -2, 3], 2), ([1, -1, -2, 3], [1, 2, 3], 2), ([1, 2, 3], [], 3), ([], [], 0), ([1, None, 3], [1, 2, 3], 1)])
def test_distance(src, tgt, cost):
    assert sq.distance(src, tgt) == cost


def test_fractional_costs():
    assert sq.distance("ab", "cd", sub=0.5) == 1.0 and sq.distance("abc", "", dele=0.25) == 0.75


def test_alignment():
    assert sq.alignment([1, 2, 3], []) == [(1, None), (2, None), (3, None)]
    assert sq.alignment([1, 2, 3], [1, -1, -2, 3]) in ([(1, 1), (2, -1), (None, -2), (3, 3)], [(1, 1), (None, -1), (2, -2), (3, 3)])


@pytest.mark.parametrize(("src", "tgt", "cost"), [([1], [2, 1], 0), ([1, 2, -1, 1, 2, 3], [1, 2, 3], 0), ([1, -1], [1, 2, 3], 1), ([], [], 0)])
def test_substring_distance(src, tgt, cost):
    assert sq.substring_distance(src, tgt) == cost


def test_substring_alignment():
    assert sq.substring_alignment([1, 2, 3, 2, 3], [1, 2, 3]) == [(1, 1), (2, 2), (3, 3), (2, None), (3, None)]
    assert sq.substring_alignment([1, 1, 1, 2, 3], [1, 2, 3]) == [(1, None), (1, None), (1, 1), (2, 2), (3, 3)]


def test_distances_against_plain_recursion():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = (rng.integers(0, 3, rng.integers(0, 7)).tolist() for _ in range(2))
        table = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        assert sq.distance(a, b) == table[-1][-1]
        pairs = sq.alignment(a, b)
        assert [x for x, _ in pairs if x is not None] == a and [y for _, y in pairs if y is not None] == b and sum(x != y for x, y in pairs) == table[-1][-1]


def _frames(text):
    return np.array([[0.0 if c == x else -80.0 for x in "abc_"] for c in text])


@pytest.mark.parametrize(("frames", "text"), [("a", "a"), ("aa", "a"), ("a_a", "aa"), ("ab", "ab"), ("aa_", "a")])
def test_decoders(frames, text):
    assert ctc.greedy(_frames(frames), ABC)[0] == text
    for k in (1, 2, 8):
        assert ctc.prefix_beam(_frames(frames), ABC, k)[0][0][0] == text


def test_beam_rules():
    assert ctc.prefix_beam(np.array([[-80, -80, -80, -5.0]]), ABC, 2, most_deviation=None)[0] == [("", -5.0, 0.0)]
    with pytest.raises(ValueError, match="normalised"):
        ctc.prefix_beam(np.array([[-10, -80, -80, -10.0]]), ABC, 2)
    bag = ctc.prefix_beam(np.array([[-2, -10, -80, -2], [-4e-4, -80, -80, -7], [-0.9, -80, -80, -0.5], [-80, -80, -80, 0.0]]), ABC, 2, most_deviation=None)[0]
    assert bag[0][0] == "a" and {t for t, _, _ in bag} <= {"a", "", "aa"}
    for bad, error in ((0, ValueError), (1.5, TypeError), (True, TypeError)):
        with pytest.raises(error):
            ctc.prefix_beam(_frames("a"), ABC, bad)
    for letters in (["a", "a", ""], ["", "a"], ["a", "b"]):
        with pytest.raises(ValueError, match="letter|blank"):
            ctc.check_alphabet(letters, "")


def test_beam_against_all_paths():
    rng = np.random.default_rng(1)
    logp = ctc.log_softmax(rng.normal(size=(4, 4)))
    total = {}
    for path in np.ndindex(*(4,) * 4):
        text = "".join(ABC[k] for i, k in enumerate(path) if k != 3 and (i == 0 or path[i - 1] != k))
        total[text] = np.logaddexp(total.get(text, -np.inf), sum(logp[t, k] for t, k in enumerate(path)))
    got = {t: v for t, v, _ in ctc.prefix_beam(logp, ABC, 500)[0]}
    assert set(got) == set(total) and all(abs(got[t] - total[t]) < 1e-9 for t in total)


def test_language_model_guides_the_beam():
    lm = ctc.NgramModel.trained(["ab"] * 50, 2, ABC[:-1])
    logp = ctc.log_softmax(np.array([[5.0, 0, 0, 0], [0, 1.0, 1.1, 0]]))
    assert ctc.prefix_beam(logp, ABC, 8)[0][0][0] == "ac"
    bag, _ = ctc.prefix_beam(logp, ABC, 8, lm, 1.0)
    assert max(bag, key=lambda h: h[1] + h[2])[0] == "ab"


@pytest.mark.parametrize(("cost", "symbols", "blank", "path"), [([[0, 10], [10, 0]], [1], 0, [0, 1]), ([[0, 10, 10], [10, 10, 0], [5, 10, 5], [10, 10, 0]], [2, 2], 0, [0, 2, 0, 2]), ([[10, 10, 0], [0, 10, 10]], [1, 2], 0, [1, 2])])
def test_forced_alignment(cost, symbols, blank, path):
    assert ctc.forced_alignment(np.array(cost, float), symbols, blank) == path


@pytest.mark.parametrize("symbols", [[], [0], [1, 1]])
def test_impossible_alignments(symbols):
    with pytest.raises(ValueError, match="align|blank"):
        ctc.forced_alignment(np.zeros((2, 2)), symbols, 0)


def test_confusion_networks():
    q = 0.24
    assert cn.added([], "abc", q) == [{"a": q}, {"b": q}, {"c": q}]
    assert cn.added([{"a": q}, {"b": q}], "a", q) == [{"a": 2 * q}, {"b": q, None: q}]
    assert cn.added([{"a": q}, {"c": q}], "abc", q) == [{"a": 2 * q}, {None: q, "b": q}, {"c": 2 * q}]
    assert cn.added([{"b": q}, {"c": q}], "abc", q) == [{None: q, "a": q}, {"b": 2 * q}, {"c": 2 * q}]
    got = cn.paths([{"a": 0.25, "b": 0.75}, {"c": 0.9, "d": 0.1}])
    assert [t for t, _ in got] == ["bc", "ac", "bd", "ad"] and np.allclose([w for _, w in got], [0.675, 0.225, 0.075, 0.025])
    middle = cn.produced([("abc", 0.0, None), ("ac", 1.0, None)])[1]
    assert math.isclose(middle["b"], 1 / (1 + math.e)) and math.isclose(middle[None], math.e / (1 + math.e))


def test_geometry():
    square = np.array([(0, 0), (4, 0), (4, 4), (0, 4)])
    assert ge.area(ge.clipped(square + 2, square)) == 4.0 and len(ge.clipped(square + 9, square)) == 0
    assert len(ge.convex_hull(np.concatenate([square, [[2, 2], [2, 0]]]))) == 4
    assert math.isclose(ge.circumradius(*np.array([(0, 0), (2, 0), (0, 2)])), math.sqrt(2))
    assert np.allclose(ge.resample(np.array([(0, 1), (9, 10)]))[3], (3, 4))
    x = np.linspace(0, 9, 5)
    assert np.allclose(ge.resample(np.stack([x, x**2 / 10], 1))[5], (5, 2.5)) and np.allclose(ge.resample(np.array([(3, 0), (3, 9)]))[1], (3, 1))
    (at, height), = ge.peaks(np.array([0, 0.2, 0.9, 1.0, 0.9, 0.2, 0]), 2)
    assert abs(at - 3) < 1e-6 and height > 0.9
    assert ge.components(5, [(0, 3), (3, 4)]) == [0, 1, 2, 0, 0]


def test_reading_order():
    columns = [(0, 0, 40, 10), (0, 12, 40, 50), (50, 0, 90, 24), (50, 26, 90, 50), (0, 60, 90, 70)]
    assert la.xy_cut(columns) == [0, 1, 2, 3, 4] and la.xy_cut([]) == [] and la.xy_cut(columns[:1]) == [0]


def test_arabic():
    for text in ("abc", "سلام abc", "abc سلام", "سلام, عليكم. 12 abc", ""):
        assert ar.reordered(ar.reordered(text)) == text
    assert ar.reordered("سلام") == "مالس" and ar.reordered("abc سلام") == "مالس abc"
    shaped = ar.shaped("سلام")
    assert shaped == "ﺳﻼﻡ" and ar.ligature_map(shaped) == [[0], [1, 2], [3]]


def test_alignments_in_batches(spark):
    """The UDFs, which fill the tables of many pairs together, against the tables of one pair each; nulls are elements."""
    rng = random.Random(17)
    some = lambda: [rng.choice(["a", "b", "c", None]) for _ in range(rng.randrange(0, 25))]
    rows = [(i, some(), some()) for i in range(150)] + [(150, None, ["a"]), (151, ["a"], None)]
    df = spark.createDataFrame(rows, "i int, x array<string>, y array<string>")
    for costs in ((1, 1, 1), (1.5, 0.5, 1)):
        out = df.select("i", "x", "y", sq.alignment_udf(*costs)("x", "y").alias("al"), sq.path_udf(*costs)("x", "y").alias("path"), sq.distance_udf(*costs)("x", "y").alias("d")).collect()
        for r in out:
            if r.x is None or r.y is None:
                assert r.al is None and r.path is None and r.d is None
            else:
                assert [(p.src, p.tgt) for p in r.al] == sq.alignment(r.x, r.y, *costs) and r.path == sq.path(r.x, r.y, *costs) and abs(r.d - sq.distance(r.x, r.y, *costs)) < 1e-9


def test_clipped_parts_against_points(spark):
    """Areas of slanted shapes in regions against the share of a fine grid's points that lie in both."""
    from quirekit.operators.layout import clipped_parts

    rng = np.random.default_rng(8)
    hull = lambda: ge.convex_hull(rng.uniform(0, 100, (7, 2)))
    lines, regions = ([(1, i, [{"x": float(x), "y": float(y)} for x, y in hull()]) for i in range(6)] for _ in range(2))
    edge = "edge array<struct<x:double,y:double>>"
    got = {(r.line, r.region): r.area for r in clipped_parts(spark.createDataFrame(lines, f"page int, line int, {edge}"), spark.createDataFrame(regions, f"page int, region int, {edge}")).collect()}
    grid = np.stack(np.meshgrid(np.arange(0.25, 100, 0.5), np.arange(0.25, 100, 0.5)), -1).reshape(-1, 2)

    def inside(poly):
        p = np.array([(q["x"], q["y"]) for q in poly])
        d = np.roll(p, -1, axis=0) - p
        side = d[:, None, 0] * (grid[None, :, 1] - p[:, None, 1]) - d[:, None, 1] * (grid[None, :, 0] - p[:, None, 0])
        return (side >= 0).all(axis=0) | (side <= 0).all(axis=0)

    for _, i, a in lines:
        for _, j, b in regions:
            want = (inside(a) & inside(b)).sum() / 4
            assert abs(got.get((i, j), 0.0) - want) < 40
