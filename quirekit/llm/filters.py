"""Bloom filters of 64-bit keys, made by tasks and sent to scans, so that rows that nothing asks for are not moved."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirekit.llm.common import BROADCAST_ROWS, column
from quirekit.llm.words import U64, mix

#: A filter has so many bits for each key, and so many in all at least and at most (8 and 128 MB). Beyond the most it is fuller and more rows are moved; results are the same.
BITS_EACH, LEAST_BITS, MOST_BITS = 12, 1 << 26, 1 << 30
#: Parts of a filter, and tasks that make it, each of a share of the keys, which are not shuffled for it.
PARTS, MAKERS = 64, 4


def _places(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of a part of n words that each key has, and its three bits there."""
    y = mix(x)
    one = U64(1)
    return ((y >> U64(32)) * U64(n) >> U64(32)).astype(np.int64), one << (y & U64(63)) | one << (y >> U64(6) & U64(63)) | one << (y >> U64(12) & U64(63))


def passes(x: np.ndarray, bloom: np.ndarray) -> np.ndarray:
    """Whether each of the 64-bit keys is in the filter: all that were put there, and some by chance."""
    n = len(bloom) // PARTS
    word, bits = _places(x, n)
    return bloom[(x & U64(PARTS - 1)).astype(np.int64) * n + word] & bits == bits


def sent_filter(keys: DataFrame, n_keys: int) -> Broadcast:
    """The filter of keys (key), about n_keys of them, sent to all executors. What the tasks have made comes to the driver one task at a time."""
    n = max(LEAST_BITS, min(MOST_BITS, BITS_EACH * n_keys)) // 64 // PARTS

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in it:
            x = column(batch, "key").to_numpy().view(np.uint64)
            part = x & U64(PARTS - 1)
            for p in np.unique(part).tolist():
                word, bits = _places(x[part == U64(p)], n)
                np.bitwise_or.at(made.setdefault(p, np.zeros(n, np.uint64)), word, bits)
        for p in list(made):
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([made.pop(p).tobytes()], pa.binary())], ["part", "bits"])

    whole = np.zeros((PARTS, n), np.uint64)
    for r in keys.select("key").coalesce(MAKERS).mapInArrow(run, "part int, bits binary").toLocalIterator():
        whole[r.part] |= np.frombuffer(r.bits, np.uint64)
    return keys.sparkSession.sparkContext.broadcast(whole.ravel())


def likely(wide: DataFrame, ids: DataFrame, on: str = "doc_id") -> DataFrame:
    """The rows of wide whose id is in ids (saved, one column), and some more by chance if those are more than BROADCAST_ROWS; no row of wide is moved."""
    n = ids.count()
    if n <= BROADCAST_ROWS:
        return wide.join(F.broadcast(ids), on, "left_semi")
    bloom = sent_filter(ids.select(F.xxhash64(on).alias("key")), n)

    @F.pandas_udf("boolean")
    def there(key):
        import pandas as pd

        return pd.Series(passes(key.to_numpy().view(np.uint64), bloom.value))

    return wide.where(there(F.xxhash64(on)))
