"""MinHash signatures, bands, links and exact checks, shared by the near-duplicate and the fingerprint operators."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirekit.llm.common import BROADCAST_ROWS, column, dropped, id_type, narrow_join, rebatched, saved
from quirekit.llm.filters import likely, sent_filter
from quirekit.llm.filters import passes as _passes
from quirekit.llm.words import U64, batches, mix, shingles, words

#: The second look takes about so many shingles of a document, twice as many at most, first to see whether others have enough of them, and then to find which; in each round it misses
#: a pair at the threshold with this probability.
SAMPLES, MISS = (16, 128), 0.025


def permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and addends of n hash functions (a*x + b mod 2^64) >> 32 over 32-bit x, a strongly universal family."""
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 63, n, np.uint64) * U64(2) + U64(1), rng.integers(0, 1 << 63, n, np.uint64) * U64(2) + rng.integers(0, 2, n, np.uint64)


def signature(x: np.ndarray, a: np.ndarray, b: np.ndarray, rows: int = 512) -> np.ndarray:
    """The minimum of each hash function over the 32-bit values x."""
    best = np.full(len(a), 0xFFFFFFFF, np.uint64)
    for i in range(0, len(x), rows):
        v = a[:, None] * x[None, i : i + rows]
        v += b[:, None]
        v >>= U64(32)
        np.minimum(best, v.min(axis=1), out=best)
    return best.astype(np.uint32)


def sets_of(texts: list[str], k: int) -> Iterator[np.ndarray]:
    """Each text's set of shingles as sorted 64-bit hashes."""
    for lo, hi in batches(texts):
        h, _, _, first, _ = words(texts[lo:hi])
        x, at = shingles(h, first, k)
        for i in range(hi - lo):
            yield np.unique(x[at[i] : at[i + 1]])


def print_of(s: np.ndarray) -> bytes:
    """A 128-bit hash of a set of 64-bit hashes: two sets of one print are taken for the same."""
    n = U64(len(s))
    return b"".join(int(mix(np.array([mix(s ^ U64(salt)).sum() + n], np.uint64))[0]).to_bytes(8, "big") for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


def signed(docs: DataFrame, k: int, n_hashes: int, seed: int) -> DataFrame:
    """(doc_id, size, print, sig) of each text that has a word: the size of its shingle set, a 128-bit hash of the set, and its signature."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = permutations(n_hashes, seed)
        for batch in rebatched(it, 2048):
            ids = column(batch, "doc_id")
            at, out = [], [[], [], []]
            for i, s in enumerate(sets_of(column(batch, "text").to_pylist(), k)):
                if len(s):
                    at.append(i)
                    for x, v in zip(out, (len(s), print_of(s), signature(s >> U64(32), a, b).tobytes())):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], ["doc_id", "size", "print", "sig"])

    return docs.mapInArrow(run, f"doc_id {id_type(docs)}, size int, print binary, sig binary")


def buckets(signs: DataFrame, schemes: dict[int, tuple[int, int]], by_size: bool = True) -> DataFrame:
    """(bucket, size, doc_id, holds) for the bands of each scheme, gap: (bands, rows), which are the first of the signature.

    Documents are partitioned by the power of 2 of their size. A scheme has buckets in each partition: the documents of the
    partition are held there, and those of the partition that is smaller by the gap ask there; at gap 0 all that are held ask, too.
    Without by_size there is one partition."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(it, 2048):
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(column(batch, "sig").to_pylist()), np.uint32).reshape(batch.num_rows, -1).astype(np.uint64)
            size, ids = column(batch, "size"), column(batch, "doc_id")
            part = np.floor(np.log2(size.to_numpy(zero_copy_only=False))).astype(np.uint64) * U64(by_size)
            for gap, (bands, rows) in schemes.items():
                values = sig[:, : bands * rows].reshape(len(sig), bands, rows)
                acc = np.broadcast_to(np.arange(bands, dtype=np.uint64) + U64(1 + 4096 * gap), values.shape[:2]).copy()
                for r in range(rows):
                    acc = mix(acc * U64(0x9E3779B97F4A7C15) + values[:, :, r])
                each = pa.array(np.repeat(np.arange(len(sig)), bands))
                for holds in (True, False) if gap else (True,):
                    key = mix(acc + (part if holds else part + U64(gap))[:, None])
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), size.take(each), ids.take(each), pa.array(np.full(key.size, holds)), pa.array(np.full(key.size, not holds or gap == 0))], ["bucket", "size", "doc_id", "holds", "asks"])

    return signs.mapInArrow(run, f"bucket bigint, size int, doc_id {id_type(signs)}, holds boolean, asks boolean")


def linked(found: DataFrame, largest: bool) -> DataFrame:
    """Distinct (doc_id, other): each document that asks in a bucket with the first that is held there, the largest or else that of the smallest doc_id.

    The firsts are plain aggregates, combined before they are shuffled, and the join that brings them back has one row to a bucket on
    their side, so a hot bucket is split among tasks. A bucket of m members gives m links at most."""
    order = F.struct(-F.col("size"), "doc_id") if largest else F.struct("doc_id")
    held = F.when(F.col("holds"), order)
    heads = found.groupBy("bucket").agg(F.min(held).alias("head"), F.count("*").alias("n")).where("n > 1 and head is not null").select("bucket", F.col("head.doc_id").alias("other"))
    return found.where("asks").select("bucket", "doc_id").join(heads, "bucket").where("other <> doc_id").select("doc_id", "other").distinct()


def least_shared(n: np.ndarray, size: np.ndarray, share: float) -> np.ndarray:
    """How many of the rarest of n samples, of a set of that size, are enough to ask with: one more than can be missing in a set that holds `share` of it.

    Where all of the set are samples that is exact; else each is missing with probability 1 - share, and as many as are missing but with probability MISS are."""
    table = {}
    for k in np.unique(n).tolist():
        tail, t = 1.0, 0
        while t < k and tail > MISS:
            tail -= math.comb(k, t) * (1 - share) ** t * share ** (k - t)
            t += 1
        table[k] = max(1, t)
    exact = n - np.ceil(share * n - 1e-9) + 1
    return np.where(n == size, exact, [table[k] for k in n.tolist()]).astype(np.int32)


def _asked(docs: DataFrame, left: DataFrame, twice: DataFrame, k: int, share: float, samples: int) -> DataFrame:
    """(doc_id, size, key, n, enough), saved: the sampled shingles of the documents in left (doc_id, size, print; saved), their number and how many of the rarest are enough to ask with.

    Where left is too large to be broadcast, all documents are sampled and their samples joined with it, not their texts."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(it, 1024):
            at, keys, size, prints = [], [], [], []
            for i, s in enumerate(sets_of(column(batch, "text").to_pylist(), k)):
                if len(s):
                    at.append(i)
                    keys.append(s[mix(s) <= U64(min((1 << 64) - 1, (samples << 64) >> int(math.log2(len(s)))))])
                    size.append(len(s))
                    prints.append(print_of(s) if several else None)
            n = np.array([len(x) for x in keys], np.int64)
            ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array((np.concatenate(keys) if keys else np.zeros(0, np.uint64)).view(np.int64)))
            size = np.array(size, np.int64)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id").take(pa.array(at, pa.int64())), pa.array(size, pa.int32()), pa.array(prints, pa.binary()), lists, pa.array(n, pa.int32()), pa.array(least_shared(n, size, share))],
                ["doc_id", "size", "print", "keys", "n", "enough"],
            )

    several, many = not twice.isEmpty(), left.count() > BROADCAST_ROWS
    asks = (docs if many else narrow_join(docs, left.select("doc_id"), "doc_id", "left_semi")).mapInArrow(run, f"doc_id {id_type(docs)}, size int, print binary, keys array<bigint>, n int, enough int")
    if several:
        asks = asks.join(left.hint("merge"), ["doc_id", "size", "print"], "left_semi").dropDuplicates(["doc_id"])
    elif many:
        asks = asks.join(left.select("doc_id").hint("merge"), "doc_id", "left_semi")
    return saved(asks.select("doc_id", "size", F.explode("keys").alias("key"), "n", "enough"))


def passing(texts: list[str], k: int, bloom: np.ndarray, sizes: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """(place, shingles that pass the filter, ascending, and the whole set if sizes) of each text with some that pass. Shingles are filtered before they are sorted."""
    for lo, hi in batches(texts):
        h, _, _, first, _ = words(texts[lo:hi])
        x, at = shingles(h, first, k)
        good = np.flatnonzero(_passes(x, bloom))
        ends = np.searchsorted(good, at)
        for i in np.flatnonzero(np.diff(ends)).tolist():
            yield lo + i, np.unique(x[good[ends[i] : ends[i + 1]]]), np.unique(x[at[i] : at[i + 1]]) if sizes else None


def _held(docs: DataFrame, asks: DataFrame, twice: DataFrame, k: int, sizes: bool) -> DataFrame:
    """(doc_id, size, key): the documents' shingles that are asked for, and some that pass the filter by chance. size is 0 where sizes aren't wanted."""
    bloom = sent_filter(asks, asks.count())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(it, 1024):
            at, keys, size, prints = [], [], [], []
            for i, own, s in passing(column(batch, "text").to_pylist(), k, bloom.value, sizes or several):
                if len(own):
                    at.append(np.full(len(own), i))
                    keys.append(own)
                    size.append(np.full(len(own), 0 if s is None else len(s), np.int32))
                    prints += [print_of(s)] * len(own) if several else [None] * len(own)
            at, size = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (at, size))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id").take(pa.array(at, pa.int64())), pa.array(size, pa.int32()), pa.array(prints, pa.binary()), pa.array((np.concatenate(keys) if keys else np.zeros(0, np.uint64)).view(np.int64))], ["doc_id", "size", "print", "key"])

    several = not twice.isEmpty()
    held = docs.mapInArrow(run, f"doc_id {id_type(docs)}, size int, print binary, key bigint")
    return one_each(held, twice, ["doc_id", "key"]).select("doc_id", "size", "key")


def sought(docs: DataFrame, signs: DataFrame, matched: DataFrame, twice: DataFrame, k: int, share: float, before: str) -> DataFrame:
    """(doc_id, other, size, other_size, agree): candidates of the documents in signs that aren't in matched (saved, one column doc_id), whatever the others' sizes.

    Each takes its shingles whose hash is under a rate that depends on its size. A set of which another holds `share` has few samples that no other set
    holds (see least_shared), and most documents drop out by that. The rest take more samples. If another set holds `share` of them, it
    holds one of the rarest few at least, so they ask with those, and with shingles that are common to many texts only if they have little else. All
    documents hold all their shingles; a Bloom filter of the asked ones is sent to the scan, so only those are moved, and of all but the last as counts. `before` says
    which others count, by (doc_id, size, other, other_size); agree is the number of asked shingles that other holds."""
    left = saved(narrow_join(signs.select("doc_id", "size", "print"), matched, "doc_id", "left_anti"))
    for samples in SAMPLES:
        asks = _asked(docs, left, twice, k, share, samples)
        counts = _held(docs, asks, twice, k, False).groupBy("key").agg(F.count("*").alias("n_holders")).where("n_holders > 1")
        some = asks.join(counts, "key").withColumn("n_held", F.count("*").over(W.partitionBy("doc_id"))).where("n_held > n - enough")
        if samples != SAMPLES[-1]:
            fewer = saved(left.join(some.select("doc_id").distinct(), "doc_id", "left_semi"))
            dropped(left, asks)
            left = fewer
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("n_holders", "key")) + F.col("n") - F.col("n_held")
    few = saved(some.withColumn("place", place).where("place <= enough").select("key", "doc_id", "size"))
    dropped(left, asks)
    held = _held(docs, few, twice, k, True)
    pairs = few.join(held.select("key", F.col("doc_id").alias("other"), F.col("size").alias("other_size")), "key").where(f"doc_id <> other and {before}")
    return pairs.groupBy("doc_id", "other", "size", "other_size").agg(F.count("*").cast("int").alias("agree"))


def agreeing(links: DataFrame, signs: DataFrame, floor: str, n_hashes: int) -> DataFrame:
    """Links with the sizes and the number of hash functions that agree, where that number is at least the expression floor of (size, other_size).

    Only the low byte of each minimum is moved and compared, so a pair that agrees in less may pass by chance, but none fails by it."""

    @F.pandas_udf("binary")
    def low(sig):
        import pandas as pd

        return pd.Series([np.frombuffer(s, np.uint32).astype(np.uint8).tobytes() for s in sig])

    @F.pandas_udf("int")
    def same(x, y):
        import pandas as pd

        left, right = (np.frombuffer(b"".join(s), np.uint8).reshape(-1, n_hashes) for s in (x, y))
        return pd.Series((left == right).sum(axis=1).astype(np.int32))

    short = saved(signs.select("doc_id", "size", low("sig").alias("sig")))
    two = short.select(F.col("doc_id").alias("other"), F.col("size").alias("other_size"), F.col("sig").alias("other_sig"))
    both = links.join(short.hint("merge"), "doc_id").join(two.hint("merge"), "other")
    return both.select("doc_id", "other", "size", "other_size", same("sig", "other_sig").alias("agree")).where(F.expr(f"agree >= {floor}"))


def needed_sets(docs: DataFrame, ids: DataFrame, twice: DataFrame, k: int, packed: Callable[[np.ndarray], bytes] = np.ndarray.tobytes) -> DataFrame:
    """(doc_id, items) of the documents in ids (saved, one column doc_id): their shingle sets as packed makes them, and a few others' by chance; of the doc_ids in twice (doc_id, size, print) the sets that it names."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(it, 512):
            sets = list(sets_of(column(batch, "text").to_pylist(), k))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array([len(s) for s in sets], pa.int32()), pa.array([print_of(s) for s in sets], pa.binary()), pa.array([packed(s) for s in sets], pa.binary())], ["doc_id", "size", "print", "items"]
            )

    found = likely(docs, ids).mapInArrow(run, f"doc_id {id_type(docs)}, size int, print binary, items binary")
    return one_each(found, twice, ["doc_id"]).select("doc_id", "items")


def shared(links: DataFrame, sets: DataFrame) -> DataFrame:
    """links with the exact number of shingles that doc_id and other share."""

    @F.pandas_udf("int")
    def common(x, y):
        import pandas as pd

        def both(p: bytes, q: bytes) -> int:
            s, t = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            if len(s) > len(t):
                s, t = t, s
            at = np.searchsorted(t, s)
            at[at == len(t)] = 0
            return int((t[at] == s).sum())

        return pd.Series([both(p, q) for p, q in zip(x, y)], dtype="int32")

    others = saved(links.select(F.col("other").alias("doc_id")).distinct())
    other = narrow_join(sets, others, "doc_id", "left_semi").select(F.col("doc_id").alias("other"), F.col("items").alias("other_items"))
    left = narrow_join(sets, links, "doc_id", "inner")
    return left.join(other.hint("merge"), "other").select(*links.columns, common("items", "other_items").alias("both"))


def one_each(rows: DataFrame, twice: DataFrame, by: list[str]) -> DataFrame:
    """rows (doc_id, size, print, ...), one for each value of `by`: where a doc_id comes with several rows, those of its text in twice (doc_id, size, print; saved)."""
    if twice.isEmpty():
        return rows
    chosen = narrow_join(rows, twice, ["doc_id", "size", "print"], "left_semi").dropDuplicates(by)
    return narrow_join(rows, twice.select("doc_id"), "doc_id", "left_anti").union(chosen)


def known(signs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of signs (saved): (doc_id, size, print, first) of each doc_id, and (doc_id, size, print) of those that come with several rows.

    The text of the largest shingle set, then of the largest hash, stands for a doc_id; first is the smallest doc_id of the same set. Only these numbers are moved, no signatures."""
    best = saved(signs.groupBy("doc_id").agg(F.max(F.struct("size", "print")).alias("s"), F.count("*").alias("rows")).select("doc_id", "s.*", "rows"))
    firsts = best.groupBy("print", "size").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    table = best.join(firsts, ["print", "size"], "left").select("doc_id", "size", "print", F.coalesce("first", "doc_id").alias("first"))
    return saved(table), saved(best.where("rows > 1").select("doc_id", "size", "print"))


def checked(docs: DataFrame, links: DataFrame, twice: DataFrame, k: int, score: str, least: float, rank: list) -> DataFrame:
    """Of each doc_id's links, the best that passes the exact check, as (doc_id, other, size, other_size, both, score), saved.

    First only each document's most promising link is checked; all other links of the documents that failed follow."""
    links = saved(links.withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy(*rank))))
    ids = saved(links.select("doc_id").union(links.select("other")).distinct())
    sets = saved(needed_sets(docs, ids, twice, k))
    first = saved(shared(saved(links.where("place = 1")), sets).withColumn("score", F.expr(score)).where(F.col("score") >= least))
    rest = saved(narrow_join(links.where("place > 1"), saved(first.select("doc_id")), "doc_id", "left_anti"))
    asked = saved(rest.select("doc_id").union(rest.select("other")).distinct())
    second = shared(rest, narrow_join(sets, asked, "doc_id", "left_semi")).withColumn("score", F.expr(score)).where(F.col("score") >= least)
    second = second.withColumn("at", F.row_number().over(W.partitionBy("doc_id").orderBy("place"))).where("at = 1").drop("at")
    good = saved(first.union(second.select(first.columns)).drop("place", "agree"))
    dropped(links, ids, sets, first, rest, asked)
    return good
