"""Hierarchical packing of documents into windows of several lengths."""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirekit.llm.common import id_type, n_tokens, saved

TIERS = (512, 2048, 8192, 32768)
#: A step group holds windows of one tier with so many positions.
STEP_TOKENS = 131_072
#: Pieces that one task packs, about; the shards' number follows from it.
SHARD_PIECES = 50_000


def pieces(docs: DataFrame, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """(doc_id, piece, start, tokens) of each text with tokens: cut where it is longer than the largest window. Tokens are words and single signs."""
    top = max(tiers)
    n = n_tokens(F.col("text").cast("string"))
    rows = docs.select(F.col("doc_id").cast(id_type(docs)).alias("doc_id"), n.alias("n")).where("n > 0")
    return rows.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / top).cast("int"))).alias("piece")).select(
        "doc_id", "piece", (F.col("piece") * top).alias("start"), F.least(F.lit(top), F.col("n") - F.col("piece") * top).cast("int").alias("tokens")
    )


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(window, offset) of each length, longest first into the fullest window with room, a new one of `size` where none has; and the (room, window) left."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    rooms: list[tuple[int, int]] = []
    made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = bisect_left(rooms, (n, -1))
        room, w = rooms.pop(at) if at < len(rooms) else (size, made)
        made += w == made
        window[i], offset[i] = w, size - room
        if room > n:
            insort(rooms, (room - n, w))
    return window, offset, rooms


def packed_shard(lengths: np.ndarray, tiers: tuple[int, ...], step_tokens: int) -> dict[str, np.ndarray]:
    """Where each piece goes: home tier, tier, window, offset, step group, and whether it fills a longer tier's gap.

    From the longest tier down, the pieces that belong to a tier and weren't used above are packed best-fit, longest
    first. Then the gaps of its windows are filled, widest first, with the longest pieces of shorter tiers that fit, until none fits. Windows are
    dealt to the tier's step groups from the fullest on, each to the group with the fewest tokens that has room."""
    tiers = tuple(sorted(tiers))
    n = len(lengths)
    home = np.searchsorted(tiers, lengths)
    out = {c: np.full(n, -1, np.int64) for c in ("tier", "window", "offset", "group")}
    fills = np.zeros(n, bool)
    free = np.ones(n, bool)
    for t in range(len(tiers) - 1, -1, -1):
        own = np.flatnonzero(free & (home == t))
        window, offset, rooms = best_fit(lengths[own], tiers[t])
        free[own] = False
        put = [own, window, offset]
        below = np.flatnonzero(free & (home < t))
        if len(below) and rooms:
            order = below[np.lexsort((-below, lengths[below]))]
            sizes = lengths[order]
            # the next piece that is still free at or below a place, found with path halving
            left = list(range(-1, len(order)))

            def find(i: int, left=left) -> int:
                while left[i + 1] != i:
                    left[i + 1] = left[left[i + 1] + 1]
                    i = left[i + 1]
                return i

            who, where, at = [], [], []
            for room, w in sorted(rooms, key=lambda r: (-r[0], r[1])):
                while room:
                    i = find(int(np.searchsorted(sizes, room, "right")) - 1)
                    if i < 0:
                        break
                    who.append(order[i])
                    where.append(w)
                    at.append(tiers[t] - room)
                    room -= int(sizes[i])
                    left[i + 1] = i - 1
            if who:
                who = np.array(who)
                free[who], fills[who] = False, True
                put = [np.concatenate([a, b]) for a, b in zip(put, (who, where, at))]
        rows, window, offset = put
        if not len(rows):
            continue
        used = np.bincount(window, lengths[rows])
        each = max(1, step_tokens // tiers[t])
        groups = -(-len(used) // each)
        load, size, of = [(0, g) for g in range(groups)], np.zeros(groups, int), np.zeros(len(used), np.int64)
        for w in np.argsort(-used, kind="stable").tolist():
            total, g = heapq.heappop(load)
            of[w] = g
            size[g] += 1
            if size[g] < each:
                heapq.heappush(load, (total + int(used[w]), g))
        out["tier"][rows], out["window"][rows], out["offset"][rows], out["group"][rows] = tiers[t], window, offset, of[window]
    return out | {"home": np.array(tiers)[home] if n else np.zeros(0, np.int64), "fills": fills}


_SCHEMA = "piece int, start int, tokens int, home int, tier int, shard int, window bigint, offset int, step_group bigint, fills_gap boolean"


def packed(docs: DataFrame, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Where each piece of each document goes: (doc_id, piece, start, tokens, home, tier, shard, window, offset, step_group, fills_gap).

    home is the shortest window that the piece fits, tier that of the window it is packed in: its own or, where it fills a gap, a longer one.
    A window is (tier, shard, window); the tokens [offset, offset + tokens) of it hold the tokens [start, start + tokens) of the document. A step group is
    (tier, shard, step_group): the windows of one training step, balanced in their number of tokens. Pieces are dealt to shards by a hash;
    the shards' number grows with the pieces, so that each is packed by one task whatever the corpus' size.

    Texts that are null or have no tokens are left out, and so are rows with a null doc_id. Rows of one doc_id are packed each; equal
    lengths are taken by (doc_id, piece, start).
    """
    rows = saved(pieces(docs.where("doc_id is not null"), tiers))
    shards = max(1, -(-rows.count() // shard_pieces))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "tokens"]).reset_index(drop=True)
        at = packed_shard(pdf.tokens.to_numpy(), tiers, step_tokens)
        return pd.DataFrame(
            {"doc_id": pdf.doc_id, "piece": pdf.piece, "start": pdf.start, "tokens": pdf.tokens, "home": at["home"], "tier": at["tier"], "shard": pdf.shard, "window": at["window"], "offset": at["offset"], "step_group": at["group"], "fills_gap": at["fills"]}
        )

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(pack, f"doc_id {id_type(rows)}, {_SCHEMA}")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
