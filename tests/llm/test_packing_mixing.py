"""Packing by its invariants and a plain reimplementation; mixing by its marginals and plain raking."""

import random

import numpy as np
import pandas as pd
import pytest
from quirekit.llm import mixing as mx
from quirekit.llm import packing as pk

from .conftest import prose


def check_windows(rows, tiers, steps):
    windows, docs, groups = {}, {}, {}
    for r in rows:
        windows.setdefault((r.tier, r.shard, r.window), []).append((r.offset, r.tokens))
        docs.setdefault((r.doc_id, r.home), []).append(r)
        groups.setdefault((r.tier, r.shard, r.step_group), set()).add(r.window)
        assert r.tokens <= r.home <= r.tier and r.fills_gap == (r.tier > r.home) and r.home == min(t for t in tiers if t >= r.tokens)
    for (tier, _, _), parts in windows.items():
        end = 0
        for offset, n in sorted(parts):
            assert offset >= end
            end = offset + n
        assert end <= tier
    assert all(len(w) <= max(1, steps // k[0]) for k, w in groups.items())


def plain(lengths, tiers):
    """The number of windows of each tier by a quadratic best fit with gaps filled."""
    left = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    count = {}
    for t in sorted(tiers, reverse=True):
        rooms = []
        for i in [i for i in left if lengths[i] <= t and all(lengths[i] > s for s in tiers if s < t)]:
            fit = min(((r, w) for w, r in enumerate(rooms) if r >= lengths[i]), default=None)
            if fit is None:
                rooms.append(t - lengths[i])
            else:
                rooms[fit[1]] -= lengths[i]
            left.remove(i)
        for w in sorted((w for w in range(len(rooms)) if rooms[w]), key=lambda w: (-rooms[w], w)):
            while fits := [i for i in left if lengths[i] <= rooms[w]]:
                i = max(fits, key=lambda i: (lengths[i], -i))
                rooms[w] -= lengths[i]
                left.remove(i)
        count[t] = len(rooms)
    return count


@pytest.mark.parametrize("seed", range(5))
def test_shards_against_plain_best_fit(seed):
    rng = np.random.default_rng(seed)
    lengths = np.concatenate([rng.integers(1, 9, 80), rng.integers(1, 33, 40), rng.integers(1, 129, 20)])
    at = pk.packed_shard(lengths, (8, 32, 128), 256)
    want = plain(lengths.tolist(), (8, 32, 128))
    assert {t: len(set(at["window"][at["tier"] == t])) for t in want if want[t]} == {t: n for t, n in want.items() if n}
    used = pd.Series(lengths).groupby([at["tier"], at["group"]]).sum()
    assert used.groupby(level=0).max().le(256).all()


def test_pieces_cover_every_token(docs_of, odd, none):
    rng = random.Random(6)
    docs = [(i, prose(rng, rng.choice([1, 5, 40, 100, 300, 1000]))) for i in range(120)] + [(200, "a,b. c!")]
    rows = pk.packed(docs_of(docs), (16, 64, 256), 1024, 40).collect()
    check_windows(rows, (16, 64, 256), 1024)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.start, r.tokens))
    counts = {i: len(t.split()) for i, t in docs} | {200: 6}
    assert set(by) == set(counts)
    for i, parts in by.items():
        end = 0
        for start, n in sorted(parts):
            assert start == end
            end += n
        assert end == counts[i]
    rows = pk.packed(odd).collect()
    assert not {2, 3, 4, None} & {r.doc_id for r in rows} and sum(r.doc_id == 1 for r in rows) == 2 and sum(r.tokens for r in rows if r.doc_id == 5) == 60_000
    check_windows(rows, pk.TIERS, pk.STEP_TOKENS)
    assert pk.packed(none).collect() == []


def test_raking_meets_its_marginals():
    rng = np.random.default_rng(1)
    cells = pd.DataFrame([(s, g, t, int(rng.integers(1, 1000))) for s in "abc" for g in "xy" for t in "pqr"], columns=[*mx.DIMS, "tokens"])
    targets = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"x": 0.9, "y": 0.1}, "topic": 0.0}
    out = mx.raked(cells, targets)
    mass = out.weight * out.tokens
    total = out.tokens.sum()
    for dim, want in (("source", targets["source"]), ("lang", targets["lang"]), ("topic", dict.fromkeys("pqr", 1 / 3))):
        for k, v in want.items():
            assert abs(mass[out[dim] == k].sum() / total - v) < 1e-6
    plain = {tuple(r[:3]): r[3] / total for r in cells.itertuples(index=False)}
    for _ in range(300):
        for i, want in enumerate((targets["source"], targets["lang"], dict.fromkeys("pqr", 1 / 3))):
            for k, v in want.items():
                own = [c for c in plain if c[i] == k]
                now = sum(plain[c] for c in own)
                for c in own:
                    plain[c] *= v / now
    for r in out.itertuples():
        assert abs(r.weight * r.tokens / total - plain[(r.source, r.lang, r.topic)]) < 1e-6


def test_probabilities_keep_the_budget():
    cells = pd.DataFrame({"tokens": [100, 200, 300, 0], "weight": [3.0, 1.0, 0.5, 0.0]})
    for keep in (0.1, 0.5, 0.9, 1.0):
        p = mx.probabilities(cells, keep).probability
        assert p.between(0, 1).all() and abs((p * cells.tokens).sum() - keep * 600) < 1e-6
    assert (mx.probabilities(cells, 0.1).probability[:3] / cells.weight[:3]).std() < 1e-9


def test_sampled_documents(spark, docs_of, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mx.mixed(docs).toPandas()
    assert len(rows) == docs.count()
    kept = rows[rows.sampled]
    assert abs(kept.tokens.sum() / rows.tokens.sum() - 0.6) < 0.1
    assert rows.groupby(list(mx.DIMS)).probability.nunique().max() == 1
    assert set(r.doc_id for r in mx.mixed_documents(docs).collect()) == set(kept.doc_id)
    words = {r.doc_id: len(r.text.split()) for r in docs.collect()}
    assert all(words[i] == n for i, n in zip(rows.doc_id, rows.tokens))
    rows = mx.mixed(odd).collect()
    assert len(rows) == odd.count() and all(r.probability is not None for r in rows) and {r.lang for r in rows} == {"en", ""}
    assert len({r.sampled for r in rows if r.doc_id == 1}) == 1
    assert mx.mixed_documents(odd).columns == odd.columns
    assert mx.mixed(none).collect() == mx.mixed_documents(none).collect() == []


def test_mixing_against_its_sql(spark, tmp_path, odd):
    """Signs that touch words, blanks of every kind, nulls and other odd rows."""
    import duckdb

    texts = ["a, b; (c) d.e", "x\ty\x0bz\x0cw\nv", "one\r\ntwo \r three", "...", "a = \"b\" @c", "p | q", "\u00a0 k\u2003l"]
    more = spark.createDataFrame([(100 + i, t, "fr" if i % 2 else "en", f"s{i % 3}") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string")
    odd.select("doc_id", "text", "lang", "source").union(more).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.execute(mx.ORACLE_SQL).fetchall()
    got = [tuple(r) for r in mx.op8_mixing(spark, str(tmp_path)).collect()]
    key = lambda r: (r[0] is None, *map(str, r[:5]))
    for x, y in zip(sorted(want, key=key), sorted(got, key=key), strict=True):
        assert x[:5] == y[:5] and x[7] == y[7] and abs(x[5] - y[5]) < 2e-6 and abs(x[6] - y[6]) < 2e-6
