"""Near duplicates and fingerprints against sets of word tuples, and signatures against their definition."""

import random
import re

import numpy as np
from pyspark.sql import functions as F
from quirekit.llm import filters as fl
from quirekit.llm import near_duplicates as nd
from quirekit.llm import set_join as sj
from quirekit.llm import signatures as sg
from quirekit.llm.fingerprints import fingerprints, similar_pairs
from quirekit.llm.words import shingles, words

from .conftest import prose


def sets(docs, k):
    out = {}
    for i, t in docs:
        ws = re.findall(r"\w+", t.lower())
        out[i] = {tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)} or ({tuple(ws)} if ws else set())
    return out


def corpus(rng):
    docs = [(i, prose(rng, rng.randrange(5, 200), 3000)) for i in range(60)]
    for i in range(60, 180):
        base = rng.choice(docs[:60])[1].split()
        kind = rng.randrange(4)
        if kind == 0:
            new = base
        elif kind == 1:
            new = [w if rng.random() > 0.03 else "zz" for w in base]
        elif kind == 2:
            new = base[: max(1, int(len(base) * rng.uniform(0.3, 1)))]
        else:
            new = base + prose(rng, rng.randrange(1, 3 * len(base)), 3000).split()
        docs.append((i, " ".join(new)))
    docs += [(i, docs[0][1]) for i in range(180, 480)]
    for i in range(480, 540):  # parts of texts up to 50 times as long, somewhat changed
        base = rng.choice(docs[:180])[1].split()
        new = [w if rng.random() > 0.03 else "zz" for w in base]
        docs.append((i, " ".join(prose(rng, rng.randrange(1, 25 * len(base)), 3000).split() + new + prose(rng, rng.randrange(1, 25 * len(base)), 3000).split())))
    return docs


def test_hashes_of_words_and_shingles():
    texts = ["Alpha beta, alpha BETA gamma.", "", "alpha", "alpha beta alpha"]
    h, s, e, first, _ = words(texts)
    assert first.tolist() == [0, 5, 5, 6, 9]
    assert h[0] == h[2] == h[5] == h[6] and h[1] == h[3] and h[0] != h[1]
    x, at = shingles(h, first, 3)
    assert np.diff(at).tolist() == [3, 0, 1, 1] and x[0] == x[4] and x[3] != x[0]


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(0)
    a, b = sg.permutations(512, 3)
    both = rng.integers(0, 1 << 32, 3000, np.uint64)
    x, y = both[:2000], both[1000:]
    same = (sg.signature(np.unique(x), a, b) == sg.signature(np.unique(y), a, b)).mean()
    assert abs(same - 1 / 3) < 0.08
    h = [min(int((int(a[0]) * int(v) + int(b[0])) % 2**64) >> 32 for v in x)]
    assert h[0] == sg.signature(x, a, b)[0]


def test_near_duplicates_against_brute_force(docs_of):
    docs = corpus(random.Random(4))
    of = sets(docs, 3)
    found = {r.doc_id: r for r in nd.near_duplicates(docs_of(docs)).collect()}
    order = lambda i: (-len(of[i]), i)
    want = {i for i in of for j in of if order(j) < order(i) and len(of[i] & of[j]) >= 0.7 * len(of[i])}
    for i, r in found.items():
        share = len(of[i] & of[r.duplicate_of]) / len(of[i])
        assert abs(share - r.containment) < 1e-6 and share >= 0.7 and order(r.duplicate_of) < order(i)
    assert set(found) <= want and len(found) >= 0.97 * len(want)
    kept = {r.doc_id for r in nd.without_near_duplicates(docs_of(docs)).collect()}
    assert kept == set(of) - set(found)
    exact = {}
    for i, s in of.items():
        exact.setdefault(frozenset(s), []).append(i)
    assert all(len(kept & set(ids)) <= 1 for ids in exact.values())


def test_fingerprints_against_brute_force(docs_of):
    docs = corpus(random.Random(5))
    of = sets(docs, 4)
    rows = {r.doc_id: r for r in fingerprints(docs_of(docs)).collect()}
    assert set(rows) == set(of)
    close = lambda i, j: len(of[i] & of[j]) / len(of[i] | of[j])
    want = {i for i in of for j in of if j < i and close(i, j) >= 0.8}
    got = {i for i, r in rows.items() if r.match_id is not None}
    assert got <= want and len(got) >= 0.97 * len(want)
    assert all(rows[i].match_id < i and abs(close(i, rows[i].match_id) - rows[i].jaccard) < 1e-6 for i in got)
    for i in of:
        assert rows[i].n_shingles == len(of[i]) and len(rows[i].signature) == 4 * 64
        assert all((rows[i].fingerprint == rows[j].fingerprint) == (of[i] == of[j]) for j in list(of)[:20])


def star(rng, edits, n=400):
    """Copies of a text with words of their own, each nearer to the original than to one another; the original is in mid-order."""
    base = prose(rng, 200, 100_000).split()
    docs = []
    for i in range(n):
        new = list(base)
        for j in rng.sample(range(len(base)), edits):
            new[j] = f"own{i}n{j}"
        docs.append((i, " ".join(base if i == n // 2 else new)))
    return docs


def test_sets_are_told_apart():
    """No two of many sets of one shingle have one print, and rare shingles are asked with."""
    texts = [f"a{i} b{i % 7}" for i in range(300_000)]
    assert len({sg.print_of(s) for s in sg.sets_of(texts, 3)}) == len(texts)
    n = np.arange(1, 40)
    t, exact = sg.least_shared(n, n + 1, 0.7), sg.least_shared(n, n, 0.7)
    rng = np.random.default_rng(4)
    assert (t <= n).all() and all(((rng.random((4000, k)) < 0.3).sum(axis=1) >= m).mean() < 0.04 or m == k for k, m in zip(n, t))
    assert all(k - m + 1 >= 0.7 * k - 1e-9 > k - m - 1e-9 for k, m in zip(n.tolist(), exact.tolist()))


def test_string_ids(spark, docs_of):
    docs = corpus(random.Random(6))[:200]
    df = docs_of(docs)
    text = df.withColumn("doc_id", F.lpad(df.doc_id.cast("string"), 5, "0"))
    for run in (nd.near_duplicates, fingerprints):
        name = "duplicate_of" if run is nd.near_duplicates else "match_id"
        one, two = run(df).collect(), run(text).collect()
        assert len(one) == len(two) and all(isinstance(r.doc_id, str) for r in two)
        assert sum(r[name] is not None for r in one) == sum(r[name] is not None for r in two)
    assert dict(nd.without_near_duplicates(text).dtypes) == dict(text.dtypes)


def test_originals_between_their_copies(docs_of):
    docs = star(random.Random(8), 5)
    of = sets(docs, 4)
    want = {i for i in of for j in of if j < i and len(of[i] & of[j]) >= 0.8 * len(of[i] | of[j])}
    got = {r.doc_id for r in fingerprints(docs_of(docs)).collect() if r.match_id is not None}
    assert len(want) > 190 and got <= want and len(got) >= 0.97 * len(want)
    docs = star(random.Random(9), 18)
    of = sets(docs, 3)
    order = lambda i: (-len(of[i]), i)
    want = {i for i in of for j in of if order(j) < order(i) and len(of[i] & of[j]) >= 0.7 * len(of[i])}
    got = {r.doc_id for r in nd.near_duplicates(docs_of(docs)).collect()}
    assert len(want) > 150 and got <= want and len(got) >= 0.95 * len(want)


def test_tuning():
    for t in (0.2, 0.5, 0.8):
        bands, rows = nd.tuned(t)
        assert bands * rows <= nd.N_HASHES and rows >= 2 and (1 - (1 - t**rows) ** bands >= nd.FIND or (bands, rows) == (32, 2))
    assert nd.jaccard_at(1.0, 1.0) == 1.0


def test_odd_rows(odd, none):
    found = {(r.doc_id, r.duplicate_of) for r in nd.near_duplicates(odd).collect()}
    assert (1, 7) in found and not {2, 3, 4, 5, 9, None} & {d for d, _ in found}
    kept = nd.without_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 2 and ids.count(8) == 1 and 1 not in ids and ids.count(5) == 1 and 2 in ids
    rows = {r.doc_id: r for r in fingerprints(odd).collect()}
    assert rows[2].fingerprint is None and rows[3].n_shingles == 0 and None not in rows and rows[5].n_shingles > 59_000
    assert nd.near_duplicates(none).collect() == fingerprints(none).collect() == nd.without_near_duplicates(none).collect() == []


def test_all_links_of_fingerprints(docs_of):
    """Every pair at the threshold, copies as one class; pairs among copies of one original are nearer to some than to others."""
    rng = random.Random(12)
    docs = corpus(rng) + [(1000 + i, t) for i, t in star(random.Random(13), 3, 120)]
    docs += [(2000 + i, " ".join(f"v{j}" for j in range(i, i + 39))) for i in range(60)]  # runs of one text, among them pairs of exactly 0.8
    of = sets(docs, 4)
    first = {}
    for i, s in sorted(of.items()):
        first.setdefault(frozenset(s), i)
    firsts = sorted(first.values())
    want = {(i, j) for i in firsts for j in firsts if j < i and len(of[i] & of[j]) >= 0.8 * len(of[i] | of[j]) - 1e-12}
    assert {(r.doc_id, r.other) for r in similar_pairs(docs_of(docs)).collect()} == want
    assert any(5 * len(of[i] & of[j]) == 4 * len(of[i] | of[j]) for i, j in want)
    rows = {r.doc_id: r for r in fingerprints(docs_of(docs)).collect()}
    for i, r in rows.items():
        assert r.class_id == first[frozenset(of[i])] and r.n_links == sum(r.class_id in p for p in want)


def test_sets_are_moved_for_links_only(docs_of, monkeypatch):
    """Pairs of a similarity of 0.6 to 0.75 have common keys enough; their sets aren't moved. Sketches drop no pair at the threshold, whatever the sizes."""
    rng = random.Random(21)
    docs = []
    for i in range(0, 120, 2):
        base = [f"u{rng.randrange(10**9)}" for _ in range(rng.randrange(300, 900))]
        n = int(len(base) * (rng.uniform(0.14, 0.25) if i % 8 else rng.uniform(0.05, 0.12)))
        docs += [(i, " ".join(base)), (i + 1, " ".join(base[:-n] + [f"n{rng.randrange(10**9)}" for _ in range(n)]))]
    of = sets(docs, 4)
    links = {(i + 1, i) for i in range(0, 120, 2) if len(of[i] & of[i + 1]) >= 0.8 * len(of[i] | of[i + 1])}
    asked, whole = [], sg.needed_sets

    def needed(docs, ids, twice, k, *packed):
        asked.extend([] if packed else [r.doc_id for r in ids.collect()])
        return whole(docs, ids, twice, k, *packed)

    monkeypatch.setattr(sj, "needed_sets", needed)
    assert {(r.doc_id, r.other) for r in similar_pairs(docs_of(docs)).collect()} == links
    assert {i for p in links for i in p} <= set(asked) and len(set(asked)) < 2 * len(links) + 20
    for n, m in ((1, 1), (3, 4), (80, 100), (127, 129), (500, 1000), (4096, 5000)):
        x = np.array([rng.randrange(1 << 64) for _ in range(n + m)], np.uint64)
        s, t = np.unique(x[:n]), np.unique(x[n // 5 : n // 5 + m])
        total, apart = sj.differing(sj.sketch(s), sj.sketch(t))
        assert total == n + m and apart <= len(np.setxor1d(s, t))


def test_passing_shingles():
    """Shingles filtered before they are sorted are those of the filtered sets."""
    rng = random.Random(14)
    texts = ["", "one", "a b", *(prose(rng, rng.randrange(1, 300), 40) for _ in range(300)), "", "x y z x y z x y z"]
    bloom = np.random.default_rng(3).integers(0, 1 << 63, 1 << 10, np.uint64)
    sets_ = list(sg.sets_of(texts, 3))
    want = {i: s[sg._passes(s, bloom)] for i, s in enumerate(sets_)}
    for sizes in (True, False):
        got = {i: (own, s) for i, own, s in sg.passing(texts, 3, bloom, sizes)}
        assert set(got) == {i for i, w in want.items() if len(w)} and len(got) > 100
        assert all((own == want[i]).all() and len(own) == len(want[i]) and (s is None or (s == sets_[i]).all()) and (s is None) != sizes for i, (own, s) in got.items())


def test_filters_grow_with_their_keys(spark, monkeypatch):
    """All keys pass and few others do, beyond the least size, too."""
    monkeypatch.setattr(fl, "LEAST_BITS", 1 << 12)
    x = np.random.default_rng(5).integers(0, 1 << 64, 200_000, np.uint64)
    keys = spark.createDataFrame([(int(v),) for v in x[:100_000].view(np.int64)], "key bigint")
    bloom = fl.sent_filter(keys, 100_000).value
    assert 64 * len(bloom) <= 12 * 100_000 and fl.passes(x[:100_000], bloom).all() and fl.passes(x[100_000:], bloom).mean() < 0.03


def test_more_ids_than_are_broadcast(docs_of, monkeypatch):
    """Without broadcasts of ids and with full filters, the same duplicates are found, and no text is shuffled for them."""
    df = docs_of(corpus(random.Random(15))[:250])
    rows = lambda: {tuple(r) for r in nd.near_duplicates(df).collect()}
    want = rows()
    for m in (sg, fl):
        monkeypatch.setattr(m, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(fl, "LEAST_BITS", 1 << 12)
    monkeypatch.setattr(fl, "MOST_BITS", 1 << 13)
    assert rows() == want and len(want) > 80
    ids = df.where("doc_id < 100").select("doc_id")
    got = fl.likely(df, ids)
    assert {r.doc_id for r in got.select("doc_id").collect()} >= set(range(100))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
