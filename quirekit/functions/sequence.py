"""Edit distances and alignments of element lists, by dynamic programming: at costs of 1 a row at a time as the bits of numbers, else in numpy.

NULL is an element like any other; two NULLs are equal. In alignments a pair has None on the side that takes no part.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

#: How a step of an alignment uses its two sides.
SOURCE, BOTH, TARGET = 1, 0, -1


def _codes(src: Sequence, tgt: Sequence) -> tuple[np.ndarray, np.ndarray]:
    seen: dict = {}
    code = lambda xs: np.array([seen.setdefault(x, len(seen)) for x in xs], np.int64)
    return code(src), code(tgt)


def _table(src: Sequence, tgt: Sequence, sub: float, ins: float, dele: float, free_start: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(last column of costs by row, moves): a move is 1 deletion, 0 pairing, -1 insertion; deletion wins ties, then pairing.

    With free_start, leading source elements cost nothing."""
    a, b = _codes(src, tgt)
    n, m = len(a), len(b)
    steps = np.arange(m + 1) * ins
    moves = np.full((n + 1, m + 1), TARGET, np.int8)
    moves[1:, 0] = SOURCE
    row = steps.astype(float)
    ends = np.empty(n + 1)
    ends[0] = row[m]
    for i in range(1, n + 1):
        gone = row + dele
        if free_start:
            gone[0] = 0.0
        both = np.full(m + 1, np.inf)
        both[1:] = row[:-1] + sub * (b != a[i - 1])
        kept = np.where(both < gone - 1e-9, BOTH, SOURCE)
        least = np.minimum(gone, both)
        best = np.minimum.accumulate(least - steps) + steps
        came = np.empty(m + 1)
        came[0], came[1:] = np.inf, best[:-1] + ins
        moves[i, 1:] = np.where(came < least - 1e-9, TARGET, kept)[1:]
        row = np.minimum(least, came)
        ends[i] = row[m]
    return ends, moves


def distance(src: Sequence, tgt: Sequence, sub: float = 1, ins: float = 1, dele: float = 1) -> float:
    """The least cost of edits that make tgt of src; costs may be fractions."""
    return float(_table(src, tgt, sub, ins, dele)[0][-1])


def _walk(moves: np.ndarray, i: int, j: int, stop_row: bool = False) -> list[int]:
    path = []
    while (i or j) and not (stop_row and j == 0):
        step = TARGET if i == 0 else SOURCE if j == 0 else int(moves[i, j])
        path.append(step)
        i -= step != TARGET
        j -= step != SOURCE
    return path[::-1]


def path(src: Sequence, tgt: Sequence, sub: float = 1, ins: float = 1, dele: float = 1) -> list[int]:
    """A cheapest alignment as steps: 1 source only, 0 both, -1 target only. Traced from the end; ties prefer 1, then 0."""
    if sub == ins == dele == 1:
        return unit_path(*_codes(src, tgt)).tolist()
    return _walk(_table(src, tgt, sub, ins, dele)[1], len(src), len(tgt))


def pairs_of(src: Sequence, tgt: Sequence, steps: Sequence[int]) -> list[tuple]:
    out, i, j = [], 0, 0
    for s in steps:
        out.append((None if s == TARGET else src[i], None if s == SOURCE else tgt[j]))
        i += s != TARGET
        j += s != SOURCE
    return out


def alignment(src: Sequence, tgt: Sequence, sub: float = 1, ins: float = 1, dele: float = 1) -> list[tuple]:
    """path() as pairs of elements."""
    return pairs_of(src, tgt, path(src, tgt, sub, ins, dele))


def substring_distance(src: Sequence, tgt: Sequence, sub: float = 1, ins: float = 1, dele: float = 1) -> float:
    """The least distance between the shorter sequence and a contiguous part, empty or not, of the longer one; 0 if both are empty."""
    long, short = (src, tgt) if len(src) >= len(tgt) else (tgt, src)
    if sub == ins == dele == 1:
        return float(min(unit_ends(*_codes(long, short))[0]))
    return float(_table(long, short, sub, ins, dele, free_start=True)[0].min())


def substring_path(src: Sequence, tgt: Sequence, sub: float = 1, ins: float = 1, dele: float = 1) -> list[int]:
    """The steps of substring_alignment()."""
    swap = len(src) < len(tgt)
    long, short = (tgt, src) if swap else (src, tgt)
    if sub == ins == dele == 1:
        costs, kept = unit_ends(*_codes(long, short))
        end = len(costs) - 1 - costs[::-1].index(min(costs))
        steps = []
        i, j = end, len(short)
        while i and j:
            gone, new = kept[i - 1]
            steps.append(SOURCE if gone >> j - 1 & 1 else TARGET if new >> j - 1 & 1 else BOTH)
            i -= steps[-1] != TARGET
            j -= steps[-1] != SOURCE
        steps = [TARGET] * j + steps[::-1]
    else:
        ends, moves = _table(long, short, sub, ins, dele, free_start=True)
        end = int(np.flatnonzero(ends <= ends.min() + 1e-9)[-1])
        steps = _walk(moves, end, len(short), stop_row=True)
    lead = end - sum(s != TARGET for s in steps)
    steps = [SOURCE] * lead + steps + [SOURCE] * (len(long) - end)
    return [-s for s in steps] if swap else steps


def substring_alignment(src: Sequence, tgt: Sequence, sub: float = 1, ins: float = 1, dele: float = 1) -> list[tuple]:
    """The alignment of substring_distance(), the skipped ends of the longer sequence paired with None; among equal parts the one that ends last."""
    return pairs_of(src, tgt, substring_path(src, tgt, sub, ins, dele))


#: Bits of the rows of one table that are kept for tracing; a larger table is filled again from rows that are kept here and there, a block of rows at a time.
KEPT_BITS = 1 << 26


def _places(b: np.ndarray) -> dict[int, int]:
    """Where each code of b is, as bits of one number."""
    out: dict[int, int] = {}
    if len(b) <= 2048:
        bit = 1
        for y in b.tolist():
            out[y] = out.get(y, 0) | bit
            bit <<= 1
        return out
    order = np.argsort(b, kind="stable")
    edge = np.flatnonzero(np.r_[True, np.diff(b[order]) != 0, True])
    bits = np.zeros(len(b), bool)
    for p, q in zip(edge[:-1].tolist(), edge[1:].tolist()):
        bits[order[p:q]] = True
        out[int(b[order[p]])] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        bits[order[p:q]] = False
    return out


def unit_distance(a: np.ndarray, b: np.ndarray) -> int:
    """The edit distance of two sequences of codes at costs of 1: a row of the table is the signs of its steps, as bits of two numbers (Myers, Hyyro)."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    same = int(differ[0]) if len(differ) else n
    a, b = a[same:], b[same:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    same = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - same], b[: len(b) - same]
    if not len(a) or not len(b):
        return len(a) + len(b)
    if len(a) < len(b):
        a, b = b, a
    at = _places(b)
    full = (1 << len(b)) - 1
    top = len(b) - 1
    up, down, cost = full, 0, len(b)
    for x in a.tolist():
        eq = at.get(x, 0)
        d0 = (((eq & up) + up) ^ up) | eq | down
        grows = down | (full & ~(d0 | up))
        falls = d0 & up
        cost += (grows >> top & 1) - (falls >> top & 1)
        grows = grows << 1 | 1
        up = full & (falls << 1 | ~(d0 | grows))
        down = grows & d0
    return cost


def unit_path(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """path() of two sequences of codes at costs of 1. Of each row are kept the places where a deletion is cheapest, and those where only an insertion is."""
    n, m = len(a), len(b)
    if not n or not m:
        return np.full(n + m, SOURCE if n else TARGET, np.int8)
    at = _places(b)
    full = (1 << m) - 1
    xs = a.tolist()

    def rows(lo: int, hi: int, up: int, down: int, keep: bool):
        out = []
        for x in xs[lo:hi]:
            eq = at.get(x, 0)
            d0 = ((((eq & up) + up) ^ up) | eq | down) & full
            grows = down | (full & ~(d0 | up))
            if keep:
                out.append((grows, d0 & ~eq))
            falls = d0 & up
            g = grows << 1 | 1
            up = full & (falls << 1 | ~(d0 | g))
            down = g & d0 & full
        return out, up, down

    size = n if n * m * 2 <= KEPT_BITS else max(1, KEPT_BITS // (2 * m))
    starts, up, down = [], full, 0
    for lo in range(0, n, size):
        starts.append((up, down))
        if lo + size < n:
            _, up, down = rows(lo, lo + size, up, down, False)
    steps = bytearray()
    j = m
    for k in range(len(starts) - 1, -1, -1):
        if not j:
            break
        lo = k * size
        kept, _, _ = rows(lo, min(n, lo + size), *starts[k], True)
        i = len(kept)
        wide = (m + 7) // 8
        bits = None
        while i and j:
            if bits is None:
                one, two = kept[i - 1]
                bits = one.to_bytes(wide, "little"), two.to_bytes(wide, "little")
            byte, bit = j - 1 >> 3, 1 << (j - 1 & 7)
            if bits[0][byte] & bit:
                steps.append(1)
                i -= 1
                bits = None
            elif bits[1][byte] & bit:
                steps.append(255)
                j -= 1
            else:
                steps.append(0)
                i -= 1
                j -= 1
                bits = None
        left = lo + i
    if j:
        left = 0
    steps += bytes([1]) * left if not j else bytes([255]) * j
    return np.frombuffer(bytes(steps), np.int8)[::-1]


def unit_ends(long: np.ndarray, short: np.ndarray) -> tuple[list[int], list[tuple[int, int]]]:
    """(the least cost of `short` and a part of `long` that ends after each of its first elements, from none to all; of each row the places where a deletion is cheapest, and those where only an insertion is) at costs of 1."""
    m = len(short)
    costs, kept = [m], []
    if not m:
        return costs * (len(long) + 1), kept
    at, full, top = _places(short), (1 << m) - 1, m - 1
    up, down = full, 0
    for x in long.tolist():
        eq = at.get(x, 0)
        d0 = ((((eq & up) + up) ^ up) | eq | down) & full
        grows = down | (full & ~(d0 | up))
        kept.append((grows, d0 & ~eq))
        falls = d0 & up
        costs.append(costs[-1] + (grows >> top) - (falls >> top))
        grows <<= 1  # a part may begin anywhere
        up = full & (falls << 1 | ~(d0 | grows))
        down = full & grows & d0
    return costs, kept


def path_cost(a: np.ndarray, b: np.ndarray, steps: np.ndarray) -> int:
    """The cost of a path at costs of 1."""
    i, j = np.cumsum(steps != TARGET) - 1, np.cumsum(steps != SOURCE) - 1
    both = steps == BOTH
    return int(np.count_nonzero(~both) + np.count_nonzero(a[i[both]] != b[j[both]]))


#: Cells of the tables of pairs that are filled together.
CELLS = 1 << 23


def many(src: list[np.ndarray], tgt: list[np.ndarray], sub: float = 1, ins: float = 1, dele: float = 1, trace: bool = True) -> tuple[np.ndarray, list[np.ndarray]]:
    """(distances, paths) of many pairs of coded sequences, as by distance() and path(): pairs of like length are filled together, a row of all their tables at a time, and traced together, unless all costs are 1. Without trace there are no paths."""
    if sub == ins == dele == 1:
        if not trace:
            return np.array([unit_distance(a, b) for a, b in zip(src, tgt)], float), []
        paths = [unit_path(a, b) for a, b in zip(src, tgt)]
        return np.array([path_cost(a, b, p) for a, b, p in zip(src, tgt, paths)], float), paths
    n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (src, tgt))
    cost, paths = np.zeros(len(src)), [np.zeros(0, np.int8)] * len(src)
    order = np.lexsort((n_b, n_a))
    at = 0
    while at < len(order):
        n = m = 0
        end = at
        while end < len(order):
            n1, m1 = max(n, int(n_a[order[end]])), max(m, int(n_b[order[end]]))
            if end > at and (end - at + 1) * (n1 + 1) * (m1 + 1) > CELLS:
                break
            n, m, end = n1, m1, end + 1
        own = order[at:end]
        at = end
        k = len(own)
        a, b = np.full((k, n), -1, np.int64), np.full((k, m), -2, np.int64)
        for r, i in enumerate(own):
            a[r, : n_a[i]], b[r, : n_b[i]] = src[i], tgt[i]
        steps = np.arange(m + 1) * float(ins)
        row = np.broadcast_to(steps, (k, m + 1)).copy()
        moves = np.full((n + 1, k, m + 1), TARGET, np.int8) if trace else None
        last = np.empty((n + 1, k))
        mine, to = np.arange(k), n_b[own]
        last[0] = row[mine, to]
        for i in range(1, n + 1):
            gone = row + dele
            both = np.full((k, m + 1), np.inf)
            both[:, 1:] = row[:, :-1] + sub * (b != a[:, i - 1 : i])
            least = np.minimum(gone, both)
            best = np.minimum.accumulate(least - steps, axis=1) + steps
            came = np.full((k, m + 1), np.inf)
            came[:, 1:] = best[:, :-1] + ins
            if trace:
                moves[i] = np.where(came < least - 1e-9, TARGET, np.where(both < gone - 1e-9, BOTH, SOURCE))
                moves[i, :, 0] = SOURCE
            row = np.minimum(least, came)
            last[i] = row[mine, to]
        cost[own] = last[n_a[own], mine]
        if not trace:
            continue
        i, j = n_a[own].copy(), n_b[own].copy()
        out = np.zeros((k, n + m), np.int8)
        length = np.zeros(k, np.int64)
        live = np.flatnonzero(i + j)
        while len(live):
            x, y = i[live], j[live]
            step = np.where(x == 0, TARGET, np.where(y == 0, SOURCE, moves[x, live, y]))
            out[live, length[live]] = step
            length[live] += 1
            i[live] -= step != TARGET
            j[live] -= step != SOURCE
            live = live[(i[live] + j[live]) > 0]
        for r, p in enumerate(own):
            paths[p] = out[r, : length[r]][::-1]
    return cost, paths


def _coded(a: pa.Array, b: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Two arrays of lists as lists of codes, equal for equal elements; a null list is an empty one."""
    both = pa.concat_arrays([a.flatten(), b.flatten()])
    codes = pc.dictionary_encode(both, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    size = [np.where(x.is_null().to_numpy(zero_copy_only=False), 0, np.nan_to_num(pc.list_value_length(x).to_numpy(zero_copy_only=False))).astype(np.int64) for x in (a, b)]
    edge = np.concatenate([[0], np.cumsum(np.concatenate(size))])
    parts = [codes[p:q] for p, q in zip(edge[:-1], edge[1:])]
    return parts[: len(a)], parts[len(a) :]


def _missing(a: pa.Array, b: pa.Array) -> pa.Array:
    return pc.or_(a.is_null(), b.is_null())


def distance_udf(sub: float = 1, ins: float = 1, dele: float = 1):
    """distance() of two array columns, NULL where either is."""

    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pc.if_else(_missing(a, b), pa.scalar(None, pa.float64()), pa.array(many(*_coded(a, b), sub, ins, dele, trace=False)[0]))

    return run


def _lists(values: pa.Array, sizes: list[int], missing: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values, mask=missing)


def path_udf(sub: float = 1, ins: float = 1, dele: float = 1):
    """path() of two array columns, NULL where either is."""

    @F.arrow_udf("array<int>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        paths = many(*_coded(a, b), sub, ins, dele)[1]
        return _lists(pa.array(np.concatenate([np.zeros(0, np.int8), *paths]).astype(np.int32)), [len(p) for p in paths], _missing(a, b))

    return run


#: Rows whose alignments are made together.
ROWS = 1024


def _alignments(paths_of):
    """A UDF of two array columns of strings: the pairs of elements of paths_of(source codes, target codes) of some rows; NULL where either is."""
    kind = pa.list_(pa.struct([("src", pa.string()), ("tgt", pa.string())]))

    def part(a: pa.Array, b: pa.Array) -> pa.Array:
        paths = paths_of(*_coded(a, b))
        steps = np.concatenate([np.zeros(0, np.int8), *paths])
        # all elements are used in their order
        sides = [values.flatten().take(pa.array(np.cumsum(steps != skip) - 1, mask=steps == skip)) for values, skip in ((a, TARGET), (b, SOURCE))]
        return _lists(pa.StructArray.from_arrays([x.cast(pa.string()) for x in sides], ["src", "tgt"]), [len(p) for p in paths], _missing(a, b)).cast(kind)

    @F.arrow_udf("array<struct<src:string,tgt:string>>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.concat_arrays([part(a.slice(at, ROWS), b.slice(at, ROWS)) for at in range(0, max(1, len(a)), ROWS)])

    return run


def alignment_udf(sub: float = 1, ins: float = 1, dele: float = 1):
    """alignment() of two array columns of strings, NULL where either is."""
    return _alignments(lambda src, tgt: many(src, tgt, sub, ins, dele)[1])


def _pandas(f, returns: str):
    """A pandas UDF of two array columns; NULL where either is."""

    @F.pandas_udf(returns)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(list(x), list(y)) for x, y in zip(a, b)], dtype=object if "array" in returns else None)

    return run


def substring_distance_udf(sub: float = 1, ins: float = 1, dele: float = 1):
    return _pandas(lambda x, y: substring_distance(x, y, sub, ins, dele), "double")


def substring_alignment_udf(sub: float = 1, ins: float = 1, dele: float = 1):
    """substring_alignment() of two array columns of strings, NULL where either is."""
    return _alignments(lambda src, tgt: [np.array(substring_path(a.tolist(), b.tolist(), sub, ins, dele), np.int8) for a, b in zip(src, tgt)])


def codes_of(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def text_distance_udf():
    """The edit distance of two text columns in characters, NULL where either is."""

    @F.arrow_udf("int")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else unit_distance(codes_of(x), codes_of(y)) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int32())

    return run


def word_distance_udf():
    """The edit distance of two text columns in words, which single blanks part, NULL where either is."""

    @F.arrow_udf("int")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        words = lambda t: [w for w in t.split(" ") if w]
        return pa.array([None if x is None or y is None else unit_distance(*_codes(words(x), words(y))) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int32())

    return run


#: Ends of texts that are compared together.
ENDS = 512


def end_distances(left: list[str], right: list[str]) -> np.ndarray:
    """For pairs of texts of up to 64 characters, a pair's of one length: the edit distances of the last n of the left and the first n of the right, n from 1 (a column each); beyond a pair's length they mean nothing.

    The first n of the right are the low bits of one number, so all n of all pairs go on together from one character of the left to the next."""
    most = max(map(len, left))
    a, b = np.full((len(left), most), 1 << 31, np.uint32), np.full((len(left), 64), (1 << 31) + 1, np.uint32)
    for i, (x, y) in enumerate(zip(left, right)):
        a[i, most - len(x) :], b[i, : len(y)] = codes_of(x), codes_of(y)
    eq = np.packbits(a[:, :, None] == b[:, None, :], axis=2, bitorder="little").view(np.uint64)[:, :, 0]
    one, top = np.uint64(1), np.arange(most, dtype=np.uint64)
    up, down = np.full((len(left), most), ~np.uint64(0)), np.zeros((len(left), most), np.uint64)
    cost = np.tile(np.arange(1, most + 1), (len(left), 1))
    for at in range(most):
        n = slice(most - at - 1, None)  # those that have begun
        u, d, e = up[:, n], down[:, n], eq[:, at : at + 1]
        d0 = (((e & u) + u) ^ u) | e | d
        grows = d | ~(d0 | u)
        falls = d0 & u
        cost[:, n] += (grows >> top[n] & one).astype(np.int64) - (falls >> top[n] & one).astype(np.int64)
        grows = grows << one | one
        up[:, n] = falls << one | ~(d0 | grows)
        down[:, n] = grows & d0
    return cost


def overlaps(left: list[str], right: list[str]) -> list[int]:
    """For each pair of texts, the n that makes the last n of the left most like the first n of the right, by the least error rate; 0 if that isn't below 1, the first at a tie."""
    out = [0] * len(left)
    most = [min(len(x), len(y)) for x, y in zip(left, right)]
    short = [i for i, n in enumerate(most) if 0 < n <= 64]
    for at in range(0, len(short), ENDS):
        own = short[at : at + ENDS]
        cost = end_distances([left[i][-most[i] :] for i in own], [right[i][: most[i]] for i in own])
        n = np.arange(1, cost.shape[1] + 1)
        rate = np.where(n <= np.array([most[i] for i in own])[:, None], cost / n, 2.0)
        best = rate.argmin(axis=1)
        for i, k, r in zip(own, best.tolist(), rate[np.arange(len(own)), best].tolist()):
            out[i] = k + 1 if r < 1 else 0
    for i, m in enumerate(most):
        if m > 64:
            a, b = codes_of(left[i][-m:]), codes_of(right[i][:m])
            rate, n = min((unit_distance(a[m - n :], b[:n]) / n, n) for n in range(1, m + 1))
            out[i] = n if rate < 1 else 0
    return out


def stitched_udf():
    """Each list of texts joined in its order, at their overlaps(): the better halves of each side; NULL where a text is."""

    @F.arrow_udf("string")
    def run(v: pa.Array) -> pa.Array:
        rows = v.to_pylist()
        out = [None if r is None or not r or None in r else r[0] for r in rows]
        left = [i for i, t in enumerate(out) if t is not None]
        k = 1
        while left := [i for i in left if len(rows[i]) > k]:
            for i, n in zip(left, overlaps([out[i] for i in left], [rows[i][k] for i in left])):
                out[i] = out[i][: len(out[i]) - n // 2] + rows[i][k][n - n // 2 :]
            k += 1
        return pa.array(out, pa.string())

    return run
