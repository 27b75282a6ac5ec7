"""Exact joins of sets of shingles by their Jaccard similarity: prefixes in one order of all shingles, and counted intersections."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirekit.llm.common import column, dropped, id_type, narrow_join, rebatched, released, saved
from quirekit.llm.signatures import needed_sets, one_each, print_of, sets_of

#: Which shingles are usual is seen in a sample of about so many documents, of so many shingles at most: those that so many of them have, and of these the most usual. It only orders shingles.
SAMPLE_DOCS, SAMPLE_SHINGLES, USUAL, MOST_USUAL = 8192, 1 << 23, 3, 1 << 18
#: Shingles of documents that are compared in one place, about.
LOAD = 1 << 22
#: Keys that a pair must have in common, where its sizes ask for so many at least; it meets at keys up to the places where that many must have come.
COMMON = 4
#: Bits of a key that stand for its place in its prefix; the last value stands for all beyond it.
PLACE_BITS = 16


def usual(docs: DataFrame, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, ascending; how many documents have them) of those that are usual in a sample of docs. All results are the same without them; they only take longer."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, n = [], 0
        for batch in it:
            for s in sets_of(column(batch, "text").to_pylist(), k) if n < SAMPLE_SHINGLES else ():
                got.append(s)
                n += len(s)
        x, counts = np.unique(np.concatenate(got), return_counts=True) if got else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        keep = np.flatnonzero(counts >= USUAL)
        keep = keep[np.argsort(-counts[keep], kind="stable")[:MOST_USUAL]]
        yield pa.RecordBatch.from_arrays([pa.array(x[keep].view(np.int64)), pa.array(counts[keep].astype(np.int64))], ["key", "n"])

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n_docs // SAMPLE_DOCS))) == 0)
    found = some.select("text").repartition(1).mapInArrow(run, "key bigint, n bigint").toArrow()
    x, n = found.column("key").to_numpy().view(np.uint64), found.column("n").to_numpy()
    o = np.argsort(x)
    return x[o], n[o]


def prefix(s: np.ndarray, n: int, order: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first n of a set of ascending hashes, in the order of all sets: unusual ones by their hash, then usual ones from the least usual on."""
    x, counts = order
    if not len(x):
        return s[:n]
    at = np.searchsorted(x, s)
    at[at == len(x)] = 0
    known = x[at] == s
    rare = s[~known]
    if len(rare) >= n:
        return rare[:n]
    often = s[known]
    return np.concatenate([rare, often[np.argsort(counts[at[known]], kind="stable")]])[:n]


def prefixes(docs: DataFrame, twice: DataFrame, k: int, jaccard: float, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, key, size): of each set of n shingles the first n - ceil(jaccard * n) + 1. Two sets of that similarity have one of them in common, the first of those that they share.

    The last PLACE_BITS of a key are its place among them, and the others those of the shingle: shingles that have these in common are one key, which adds pairs to check but loses none."""
    sent, several = docs.sparkSession.sparkContext.broadcast(order), not twice.isEmpty()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(it, 1024):
            at, keys, size, prints = [], [], [], []
            for i, s in enumerate(sets_of(column(batch, "text").to_pylist(), k)):
                if len(s):
                    own = prefix(s, len(s) - int(np.ceil(jaccard * len(s) - 1e-9)) + 1, sent.value)
                    own = own & ~last | np.minimum(np.arange(len(own), dtype=np.uint64), last)
                    at.append(np.full(len(own), i))
                    keys.append(own)
                    size.append(np.full(len(own), len(s), np.int32))
                    prints += [print_of(s)] * len(own) if several else []
            at, keys, size = (np.concatenate(c) if c else np.zeros(0, t) for c, t in ((at, np.int64), (keys, np.uint64), (size, np.int32)))
            cols = [column(batch, "doc_id").take(pa.array(at)), pa.array(size), *([pa.array(prints, pa.binary())] if several else []), pa.array(keys.view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names)

    last = np.uint64((1 << PLACE_BITS) - 1)
    names = ["doc_id", "size", *(["print"] if several else []), "key"]
    found = docs.mapInArrow(run, f"doc_id {id_type(docs)}, size int, {'print binary, ' if several else ''}key bigint")
    return one_each(found, twice, ["doc_id", "key"]).select("doc_id", "key", "size")


def meeting(keyed: DataFrame, jaccard: float) -> DataFrame:
    """(doc_id, other), other the smaller: all pairs whose sizes and number of common keys allow the similarity.

    keyed has the prefixes(). Sets of n and m shingles with that similarity share a = ceil(jaccard / (1 + jaccard) * (n + m)) at least. The c-th of those that they share has a - c of them after it, so
    it is among the first n - a + c of the one and m - a + c of the other: pairs meet only at keys in such places, for c of COMMON, or fewer where that would reach beyond a prefix, and c times at least."""
    kind = id_type(keyed)

    def pairs(ids: pa.Array, key: np.ndarray, place: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.arange(len(key) - 1)
        d = 1
        while len(at):  # sizes ascend in a key: a row is done once one is too large for it
            at = at[at + d < len(key)]
            at = at[(key[at] == key[at + d]) & (jaccard * size[at + d] <= size[at] + 1e-9)]
            to = at + d
            both = least_both(size[at] + size[to], jaccard)
            least = np.clip(both - np.ceil(jaccard * size[to] - 1e-9) + 1, 1, COMMON)
            early = (place[at] < size[at] - both + least) & (place[to] < size[to] - both + least)
            one, two, least = at[early], to[early], least[early].astype(np.int32)
            for a in range(0, len(one), 1 << 16):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(c[a : a + (1 << 16)])) for c in (one, two)] + [pa.array(least[a : a + (1 << 16)])], ["a", "b", "least"])
            d += 1

    def groups(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows).combine_chunks()
        key, size = (t.column(c).to_numpy() for c in ("key", "size"))
        key, place = key >> PLACE_BITS, key & last
        place[place == last] = 0  # or any other beyond it, which leaves a pair in
        same = key[1:] == key[:-1]
        more = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
        if len(more):
            yield from pairs(t.column("doc_id").take(pa.array(more)).combine_chunks(), key[more], place[more], size[more].astype(np.int64))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in it:
            if not batch.num_rows:
                continue
            key = column(batch, "key").to_numpy() >> PLACE_BITS
            cut = int(np.searchsorted(key, key[-1]))  # where the last key, which may go on, begins
            if cut or (held and column(held[0], "key")[0].as_py() >> PLACE_BITS != key[0]):
                yield from groups([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from groups(held)

    last, shingle = (1 << PLACE_BITS) - 1, F.shiftright("key", PLACE_BITS)
    met = keyed.repartition(shingle).sortWithinPartitions(shingle, "size").mapInArrow(run, f"a {kind}, b {kind}, least int").where("a <> b")
    met = met.groupBy(F.greatest("a", "b").alias("doc_id"), F.least("a", "b").alias("other"), "least").agg(F.count("*").alias("n"))
    return met.where("n >= least").select("doc_id", "other")


def least_both(sizes: np.ndarray | int, jaccard: float) -> np.ndarray:
    """How many shingles two sets of so many in all share at least if they have the similarity."""
    return np.ceil(jaccard / (1 + jaccard) * sizes - 1e-6)


def sketch(s: np.ndarray) -> bytes:
    """The size of a set, and two to four bits for each of its shingles: whether an odd number of them falls on each."""
    bits = 1 << max(6, (2 * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return len(s).to_bytes(8, "little") + np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differing(p: bytes, q: bytes) -> tuple[int, int]:
    """(sizes of two sets together, a number that at least so many shingles are in only one of them), by their sketches. The wider one is folded."""
    x, y = (int.from_bytes(z[8:], "little") for z in (p, q))
    n, m = 8 * len(p) - 64, 8 * len(q) - 64
    while n > m:
        n //= 2
        x = x >> n ^ x & (1 << n) - 1
    while m > n:
        m //= 2
        y = y >> m ^ y & (1 << m) - 1
    return int.from_bytes(p[:8], "little") + int.from_bytes(q[:8], "little"), (x ^ y).bit_count()


def common(p: bytes, q: bytes) -> int:
    """The number of shingles that two sets share."""
    s, t = sorted((np.frombuffer(z, np.uint64) for z in (p, q)), key=len)
    to = np.searchsorted(t, s)
    to[to == len(t)] = 0
    return int((t[to] == s).sum())


def counted(docs: DataFrame, pairs: DataFrame, sizes: DataFrame, twice: DataFrame, k: int, jaccard: float) -> DataFrame:
    """(doc_id, other, both), saved: of pairs (doc_id, other; saved), all that have the similarity and some others, with the exact number of shingles that they share. sizes has (doc_id, size).

    First only sketches of the sets are moved; by them a pair is dropped if it surely differs in too many shingles."""

    def alike(p: bytes, q: bytes) -> int | None:
        total, apart = differing(p, q)
        return None if apart > total - 2 * least_both(total, jaccard) else 0

    near = compared(docs, pairs, sizes, twice, k, sketch, alike)
    found = compared(docs, near, sizes, twice, k, None, common)
    dropped(near)
    return found


def compared(docs: DataFrame, pairs: DataFrame, sizes: DataFrame, twice: DataFrame, k: int, packed: Callable[[np.ndarray], bytes] | None, compare: Callable[[bytes, bytes], int | None]) -> DataFrame:
    """pairs (doc_id, other; saved) with `both`, what compare gives for their sets, as bytes or as packed makes them, saved. Those of which it gives None are left out.

    Documents are grouped by the smallest that they are paired with, and those of two groups that have pairs are brought together, so that a set is moved once for a group, not for each pair.
    Groups of more than LOAD shingles are split."""
    kind = id_type(pairs)
    ways = pairs.select("doc_id", "other").union(pairs.select(F.col("other").alias("doc_id"), F.col("doc_id").alias("other")))
    labels = saved(ways.groupBy("doc_id").agg(F.min("other").alias("other")).select("doc_id", F.least("doc_id", "other").alias("label")).join(sizes, "doc_id"))
    parts = labels.groupBy("label").agg(F.ceil(F.sum("size") / LOAD).alias("parts"))
    part_of = saved(labels.join(parts, "label").select("doc_id", F.xxhash64("label", F.pmod(F.xxhash64("doc_id"), F.col("parts"))).alias("part")))
    own, others = part_of.withColumnRenamed("part", "own"), part_of.select(F.col("doc_id").alias("other"), F.col("part").alias("theirs"))
    cells = narrow_join(narrow_join(pairs, own, "doc_id", "inner"), others, "other", "inner")
    cells = saved(cells.select(F.xxhash64(F.least("own", "theirs"), F.greatest("own", "theirs")).alias("cell"), "doc_id", "other"))
    places = saved(cells.select("cell", "doc_id").union(cells.select("cell", F.col("other").alias("doc_id"))).distinct())
    sets = narrow_join(needed_sets(docs, saved(part_of.select("doc_id")), twice, k, *([packed] if packed else [])), places, "doc_id", "inner")
    rows = sets.select("cell", "doc_id", F.lit(None).cast(kind).alias("other"), "items").union(cells.select("cell", "doc_id", "other", F.lit(None).cast("binary").alias("items")))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, have = None, {}
        for batch in rebatched(it, 2048):
            at, n = [], []
            for i, (cell, x, y, items) in enumerate(zip(*(column(batch, c).to_pylist() for c in ("cell", "doc_id", "other", "items")))):
                if cell != now:
                    now, have = cell, {}
                if y is None:
                    have[x] = items
                elif (both := compare(have[x], have[y])) is not None:
                    at.append(i)
                    n.append(both)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id").take(at), column(batch, "other").take(at), pa.array(n, pa.int32())], ["doc_id", "other", "both"])

    met = rows.repartition("cell").sortWithinPartitions("cell", F.asc_nulls_first("other")).mapInArrow(run, f"doc_id {kind}, other {kind}, both int")
    found = saved(met)
    dropped(labels, part_of, cells, places)
    return found


def similar_sets(docs: DataFrame, table: DataFrame, twice: DataFrame, k: int, jaccard: float) -> DataFrame:
    """(doc_id, other, score), saved: all pairs of documents in docs whose sets of shingles have a Jaccard similarity of `jaccard` at least, other the smaller doc_id.

    table (doc_id, size; saved) has the documents' sizes; twice is as in known(). docs are expected to have no two documents of one set."""
    if not 0 < jaccard <= 1:
        raise ValueError(f"jaccard must be above 0 and at most 1: {jaccard}")
    met = saved(meeting(prefixes(docs, twice, k, jaccard, usual(docs, table.count(), k)), jaccard))
    released(docs.sparkSession)  # the prefixes
    found = counted(docs, met, table.select("doc_id", "size"), twice, k, jaccard)
    one, two = table.select("doc_id", "size"), table.select(F.col("doc_id").alias("other"), F.col("size").alias("other_size"))
    score = F.col("both") / (F.col("size") + F.col("other_size") - F.col("both"))
    good = saved(narrow_join(narrow_join(found, one, "doc_id", "inner"), two, "other", "inner").select("doc_id", "other", score.alias("score")).where(F.col("score") >= jaccard))
    dropped(met, found)
    return good
