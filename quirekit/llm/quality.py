"""A quality classifier that learns from pairs of documents which of the two is better."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirekit.llm.common import column, id_type, narrow_join, rebatched, saved
from quirekit.llm.words import U64, batches, mix, words

FEATURES = ("upper", "digits", "exclaims", "symbols", "bars", "stops", "lines", "non_ascii", "word_length", "length_spread", "log_words", "again", "distinct", "longest")
#: At most so many labelled documents are learned from; those with the smallest hash of doc_id are taken.
TRAIN_ROWS = 20_000
#: Each rejected example is paired with so many accepted ones.
PAIRS_EACH = 20

_KIND = np.full(256, 3, np.uint8)  # symbols
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2
_KIND[[32, 9, 13]] = 4
_KIND[10], _KIND[33], _KIND[124], _KIND[128:] = 5, 6, 7, 8
_KIND[[46, 44, 63, 59, 58]] = 9
_KIND[[39, 45, 34, 40, 41]] = 10  # common in any text


def features(texts: list[str]) -> np.ndarray:
    """A row of FEATURES for each text, of all its bytes and words; a text without words has a row of nan."""
    out = np.full((len(texts), len(FEATURES)), np.nan)
    for lo, hi in batches(texts):
        part = texts[lo:hi]
        h, s, e, first, at = words(part)
        raw = np.frombuffer("\n".join(part).encode("utf-8", "replace") + b"\n", np.uint8)
        n = hi - lo
        doc = np.repeat(np.arange(n), np.diff(at))
        kinds = np.bincount(doc * 11 + _KIND[raw], minlength=11 * n).reshape(n, 11).astype(float)
        count = np.diff(first)
        owner = np.repeat(np.arange(n), count)
        length = (e - s).astype(float)
        some = np.maximum(count, 1)
        mean = np.bincount(owner, length, n) / some
        spread = np.sqrt(np.maximum(np.bincount(owner, length**2, n) / some - mean**2, 0))
        again = np.bincount(owner[1:][(h[1:] == h[:-1]) & (owner[1:] == owner[:-1])], minlength=n) / some
        keyed = np.sort(mix(h + owner.astype(np.uint64)) & U64((1 << 44) - 1) | owner.astype(np.uint64) << U64(44))
        fresh = np.ones(len(keyed), bool)
        fresh[1:] = keyed[1:] != keyed[:-1]
        distinct = np.bincount((keyed[fresh] >> U64(44)).astype(np.int64), minlength=n) / some
        longest = np.zeros(n)
        np.maximum.at(longest, owner, length)
        letters = np.maximum(kinds[:, 0] + kinds[:, 1] + kinds[:, 8], 1)
        per = kinds / some[:, None]
        # distinct words become rarer as a text grows: compared with a text of that many words
        rows = np.stack([kinds[:, 1] / letters, per[:, 2], per[:, 6], per[:, 3], per[:, 7], per[:, 9], per[:, 5], kinds[:, 8] / letters, mean, spread, np.log(some), again, distinct + 0.1 * np.log(some), np.log1p(longest)], axis=1)
        rows[count == 0] = np.nan
        out[lo:hi] = rows
    return out


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the features of each row that has a doc_id; x is null for a text that is null or has no words."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(it, 2048):
            x = features([t or "" for t in column(batch, "text").to_pylist()])
            rows = [None if np.isnan(r[0]) else r for r in x]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    rows = docs.select(F.col("doc_id").cast(id_type(docs)).alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    return rows.mapInArrow(run, f"doc_id {id_type(docs)}, x array<double>")


def fit(good: np.ndarray, bad: np.ndarray, seed: int = 3, ridge: float = 1e-3, steps: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, scale, weights): a Bradley-Terry model in which good wins over bad with probability sigmoid(w (good - bad)).

    Newton's method on the logistic loss over pairs, with a ridge. Without an example on either side all weights are 0."""
    both = np.concatenate([good, bad])
    if not len(good) or not len(bad):
        n = both.shape[1]
        return np.zeros(n), np.ones(n), np.zeros(n)
    centre, scale = both.mean(axis=0), np.maximum(both.std(axis=0), 1e-6)
    rng = np.random.default_rng(seed)
    pick = rng.integers(0, len(good), (len(bad), PAIRS_EACH))
    diff = (np.clip((good - centre) / scale, -8, 8)[pick] - np.clip((bad - centre) / scale, -8, 8)[:, None, :]).reshape(-1, both.shape[1])
    w = np.zeros(both.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        grad = diff.T @ p / len(diff) - ridge * w
        hess = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w += step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return centre, scale, w


def scored(docs: DataFrame, labels: DataFrame, quantile: float = 0.004, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Each document's score and whether it stays: (doc_id, score, threshold, keep).

    Pairs of a document labelled quality 1 and one labelled 0 are preferences; a linear score of the features is fitted to
    them by the logistic loss of the differences of features, on at most train_rows labelled documents (those
    of the smallest hash of doc_id). threshold is the `quantile` of the scores of all documents labelled 1,
    so a corpus with little junk loses little. Documents that score less are rejected, and so are those without a word.

    A doc_id with several labels counts as 1 if all are 1; null labels and labels of other documents are left out. Without labels of both
    kinds all scores are 0 and every document with a word stays. Rows without a doc_id are left out. Rows of one
    doc_id are scored each and stand together: the lowest score counts, and one row comes out.
    """
    x = saved(featured(docs))
    known = labels.select(F.col("doc_id").cast(id_type(docs)).alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rated = saved(x.where("x is not null").join(known, "doc_id"))
    share = min(1.0, 1.1 * train_rows / max(1, rated.count()))  # a cut by the hash first, so that no task sends more than its share
    few = rated.where(F.xxhash64("doc_id") <= F.lit(int(share * (1 << 64)) - (1 << 63) - 1).cast("bigint"))
    sample = few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).select("quality", "x").toPandas()
    of = lambda q: np.array(sample.x[sample.quality == q].tolist(), float).reshape(-1, len(FEATURES))
    centre, scale, w = fit(of(1), of(0))

    @F.pandas_udf("double")
    def score(v):
        import pandas as pd

        m = np.array([[np.nan] * len(w) if r is None else r for r in v], float).reshape(-1, len(w))
        return pd.Series(np.round(np.clip((m - centre) / scale, -8, 8) @ w, 9))

    limit = rated.where("quality = 1").agg(F.percentile_approx(score("x"), quantile, 100_000).alias("threshold"))
    rows = x.select("doc_id", F.when(F.col("x").isNotNull(), score("x")).alias("score"))
    low = F.min(F.coalesce("score", F.lit(float("-inf"))))
    one = rows.groupBy("doc_id").agg(low.alias("score")).crossJoin(F.broadcast(limit))
    lost = F.col("score") == float("-inf")
    return one.select("doc_id", F.when(~lost, F.col("score")).alias("score"), "threshold", (~lost & (F.col("score") >= F.coalesce("threshold", F.lit(float("-inf"))))).alias("keep"))


def good_documents(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """docs without those that scored() rejects; rows without a doc_id stay, and of several rows of one doc_id all stay or none. Other columns may have any names. An empty table gives an empty one."""
    gone = saved(scored(docs, labels, **params).where("not keep").select("doc_id"))
    kept = narrow_join(docs.withColumn("doc_id", F.col("doc_id").cast(id_type(docs))), gone, "doc_id", "left_anti")
    return kept.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)).select(docs.columns)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
