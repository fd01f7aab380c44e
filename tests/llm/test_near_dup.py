import random
import re

import numpy as np
import pytest
from awkward import ROWS, documents, empty

from shapeloom.llm import near_dup as N
from shapeloom.llm.components import connected_components


def shingles(t, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, width, percent):
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            sets.setdefault(i, shingles(t, width))
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return sorted(repr((i, len(shingles(t, width)), None if i is None else find(i), i is None or find(i) == i)) for i, t, *_ in rows)


def got(df):
    return sorted(repr(tuple(r)) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_awkward(spark, width, percent):
    rows = [r for r in ROWS if r[0] != 6] + [(6, ROWS[4][1] + " more", "en")]
    assert got(N.near_duplicates(documents(spark, rows), width, percent)) == brute(rows, width, percent)


def test_empty(spark):
    assert N.near_duplicates(empty(spark), 5, 80).count() == 0


def corpus(seed, groups=12, size=14):
    """Groups of copies with edits, so that similarities lie on both sides of the threshold."""
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(40, 160))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(0, 9)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy), "en"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("members", [N.BLOCK_MEMBERS, 5])
def test_groups(spark, monkeypatch, members):
    """Also with blocks so small that each group spans several."""
    monkeypatch.setattr(N, "BLOCK_MEMBERS", members)
    rows = corpus(3)
    assert got(N.near_duplicates(documents(spark, rows), 3, 85)) == brute(rows, 3, 85)


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(N, "BROADCAST_BYTES", 0)
    rows = corpus(4, groups=4)
    assert got(N.near_duplicates(documents(spark, rows), 5, 80)) == brute(rows, 5, 80)


def test_banding_and_pruning():
    for percent in (80, 85):
        r, b = N.banding(percent)
        assert r * b <= N.HASHES and (1 - (percent / 100) ** r) ** b <= N.BAND_MISS
        # a pair at the threshold is pruned with no more than the chance of a miss for each look
        rng = np.random.default_rng(1)
        steps = N.least_matches(percent, r * b, 1e-3)
        same = rng.random((20_000, r * b)) < percent / 100
        lost = np.zeros(20_000, bool)
        for n, m in steps:
            lost |= same[:, :n].sum(1) < m
        assert lost.mean() < 1e-3 * len(steps) * 2


def test_signatures_estimate():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = np.unique(x[:2000]), np.unique(x[500:2500])
    sig = N.signatures([a, b], 2048)
    assert abs((sig[0] == sig[1]).mean() - 1500 / 2500) < 0.06


def test_word_hashes_in_chunks(monkeypatch):
    """Texts cut into chunks and segments hash as they do whole."""
    from shapeloom.llm import textops as X

    rng = random.Random(4)
    texts = ["".join(rng.choice(["ab", " ", "\t", "é", "xyz", " \n"]) for _ in range(rng.randrange(0, 60))).encode() for _ in range(80)] + [b"q" * 300, b"", b"a " * 200]
    whole = X.hash_words(texts)
    assert whole[1].tolist() == np.cumsum([0, *(len(t.split()) for t in texts)]).tolist()
    assert len({*whole[0].tolist()}) == len({w for t in texts for w in t.split()})
    monkeypatch.setattr(X, "CHUNK", 50)
    parts = X.hash_words(texts)
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])
    assert X.hash_words([])[0].size == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, 3), (3, 9), (9, 7), (5, 5), (900, 1), (1, 800)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{k: 100 for k in range(100, 161)}, 3: 3, 7: 3, 9: 3, 900: 1, 800: 1, 1: 1}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
