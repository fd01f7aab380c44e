import random
import re

import numpy as np
import pytest
from awkward import documents, empty

from shapeloom.llm import decontaminate as D


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())


def distance(item, text):
    """Plain dynamic programming: the item against the best part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return min(row)


def test_best_match_is_the_distance():
    rng = random.Random(1)
    for _ in range(600):
        item = [rng.randrange(1, 6) for _ in range(rng.randrange(1, 90))]
        text = [rng.randrange(0, 6) for _ in range(rng.randrange(0, 120))]
        assert D.best_match(item, text)[0] == distance(item, text)
    d, end = D.best_match([1, 2, 3], [0, 1, 2, 3, 0])
    assert (d, end) == (0, 3)


@pytest.fixture(scope="module")
def world():
    rng = random.Random(7)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "tu", "ré") for b in ("st", "nd", "r", "", "lly")] + ["the", "of", "and"] * 12
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(some(rng.randrange(9, 60)))) for k in range(60)] + [(100, "too short"), (101, None), (102, "")]
    docs = []
    for k in range(260):
        text = some(rng.randrange(0, 160))
        if k % 2:
            item = items[rng.randrange(60)][1].split()
            for _ in range(rng.randrange(0, len(item) // 4 + 1)):
                at = rng.randrange(len(item))
                item[at : at + 1] = rng.choice([[], [rng.choice(vocabulary)], [item[at], "zz"]])
            at = rng.randrange(len(text) + 1)
            text[at:at] = item
        docs.append((k, (", " if k % 3 else " ").join(text).title() if k % 5 == 0 else " ".join(text), "en"))
    return docs, items


def test_recall_and_precision(spark, world):
    docs, items = world
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in D.contamination(documents(spark, docs), benchmark).collect()}
    truth = {}
    for i, t, _ in docs:
        w = words(t)
        for k, item in items:
            if len(q := words(item)) >= 8 and (d := distance(q, w)) <= D.allowed(len(q), 80):
                truth[i, k] = d
    assert got.items() <= truth.items()  # nothing false, and the least distance
    exact = {k for k, d in truth.items() if d == 0}
    assert exact <= set(got) and len(exact) > 20
    assert len(got) >= 0.95 * len(truth) and len(truth) > 80


def test_blocks_are_the_whole(spark, world):
    docs, items = world
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    key = lambda df: sorted((r.doc_id, r.item_id) for r in df.where("edits = 0").collect())
    df = documents(spark, docs[:80])
    assert key(D.contamination(df, benchmark)) == key(D.contamination(df, benchmark, block_items=17))


def test_awkward(spark):
    from awkward import ROWS

    item = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [*ROWS, (30, f"x {item} y", "en"), (30, f"x {item} y", "en"), (None, item, "en"), (31, item.upper().replace(" ", "\n"), "en"), (32, item[:20], "en")]
    benchmark = spark.createDataFrame([(1, item), (2, item), (None, item), (3, None)], "item_id long, text string")
    got = sorted(repr((r.doc_id, r.item_id, r.edits)) for r in D.contamination(documents(spark, rows), benchmark).collect())
    assert got == sorted(repr((i, k, 0)) for i in (30, 30, None, 31) for k in (1, 2))
    assert D.contamination(empty(spark), benchmark).count() == 0
    assert D.contamination(documents(spark), benchmark.where("false")).count() == 0


def with_edits(rng, item, n, pattern):
    copy = list(item)
    places = [(2 * e + 1) * len(copy) // (2 * n) for e in range(n)] if pattern == "spread" else rng.sample(range(len(copy)), n)
    for at in sorted(places, reverse=True):
        copy[at : at + 1] = ["zz"] if pattern != "mixed" else rng.choice([[], ["zz"], [copy[at], "zz"]])
    return copy


@pytest.mark.parametrize("pattern", ["spread", "replaced", "mixed"])
def test_copies_are_found(spark, pattern):
    """Copies with all the edits allowed, wherever these are: the recall aimed at, the least distance, nothing else."""
    rng = random.Random(3)
    items = [(k, [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(8, 90))]) for k in range(150)]
    docs, truth = [], {}
    for k, item in items:
        copy = with_edits(rng, item, D.allowed(len(item), 80), pattern)
        docs.append((k, " ".join(["before", *copy, "after"]), "en"))
        truth[k, k] = distance(item, copy)
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in D.contamination(documents(spark, docs), benchmark).collect()}
    assert got.items() <= truth.items() and len(got) >= 0.98 * len(truth)


@pytest.mark.parametrize("n", range(1, 61))
def test_recall_by_length(n):
    """Items of each length, short ones with edits too, over few and over many words; unchanged ones are all found."""
    rng = random.Random(n)
    for words_ in (400, 20_000):
        items = [(k, [f"w{int(words_ * rng.random() ** 2)}" for _ in range(n)]) for k in range(40)]
        searcher = D.Searcher([(k, " ".join(w)) for k, w in items], 80, 1)
        for pattern in (None, "spread", "replaced", "mixed"):
            docs = [" ".join(["x", "y", *(with_edits(rng, w, D.allowed(n, 80), pattern) if pattern else w), "z"]).encode() for _, w in items * 3]
            got = {(d, k) for d, k, *_ in searcher.search(docs)}
            assert sum((d, d % 40) in got for d in range(120)) >= (0.95 if pattern else 1) * 120, (words_, pattern, searcher.classes)


def test_walks_see_no_more_words_than_steps():
    """So a walk of so many steps as words stand unchanged side by side misses nothing."""
    known, at, of, offset = D._laid([np.arange(1, 60, dtype=np.uint64)])
    for steps, sampled in D.WALKS:
        walks = D.Walks(steps, sampled)
        changed = known.copy()
        changed[at[10 + steps :]] = 0
        for r in range(D.REPETITIONS):
            assert walks.keys(r, known, D._bits(known), at[10:11])[1] == walks.keys(r, changed, D._bits(known), at[10:11])[1]


def test_short_items_are_found_unchanged(spark):
    benchmark = spark.createDataFrame([(1, "Who wrote Faust?"), (2, "one two three four five six seven"), (3, "Paris")], "item_id long, text string")
    docs = [(1, "asked: who wrote faust, then", "en"), (2, "who wrote a faust", "en"), (3, "zero one two three four five six seven", "en"), (4, "one two three four five six eight", "en"), (5, "in Paris.", "en"), (6, "who wrote", "en")]
    got = sorted((r.doc_id, r.item_id, r.edits) for r in D.contamination(documents(spark, docs), benchmark).collect())
    assert got == [(1, 1, 0), (3, 2, 0), (5, 3, 0)]


def test_scripts_without_spaces(spark):
    chinese, thai = "光合作用把光能转化为什么形式的能量", "พืชใช้แสงแดดเพื่อสร้างอาหารของมันเอง"
    benchmark = spark.createDataFrame([(1, chinese), (2, thai)], "item_id long, text string")
    docs = [(1, f"问题：{chinese}？答案", "zh"), (2, f"问题{chinese[:5]}，{chinese[5:9]}换{chinese[10:]}", "zh"), (3, f"ก {thai} ข", "th"), (4, chinese[:8], "zh")]
    got = sorted((r.doc_id, r.item_id, r.edits) for r in D.contamination(documents(spark, docs), benchmark).collect())
    assert got == [(1, 1, 0), (2, 1, 1), (3, 2, 0)]


def test_items_not_searched_for_are_reported(spark, caplog):
    benchmark = spark.createDataFrame([(1, "alpha beta"), (None, "gamma"), (3, None), (4, " ?! ")], "item_id long, text string")
    D.contamination(documents(spark), benchmark)
    assert "3 of 4 items" in caplog.text


def test_texts_with_one_item_id(spark):
    """Two items whose candidates stand at one place, and only the second is there."""
    a, b = [f"a{k}" for k in range(20)], [f"b{k}" for k in range(20)]
    first, second = a[:4] + b[4:], a
    benchmark = spark.createDataFrame([(1, " ".join(first)), (1, " ".join(second)), (1, " ".join(second)), (1, " ".join(["c", *a[1:]]))], "item_id long, text string")
    got = lambda **kw: sorted((r.doc_id, r.item_id, r.edits) for r in D.contamination(documents(spark, [(1, " ".join(a), "en"), (2, " ".join(first), "en")]), benchmark, **kw).collect())
    assert got() == got(block_items=1) == [(1, 1, 0), (1, 1, 1), (2, 1, 0)]


def test_a_failed_candidate_hides_no_other_item():
    a = [f"a{k}" for k in range(20)]
    for other in (a[:4] + [f"b{k}" for k in range(16)], [f"b{k}" for k in range(16)] + a[16:]):
        for items in ([(1, " ".join(other)), (1, " ".join(a))], [(1, " ".join(a)), (1, " ".join(other))]):
            assert [x[:3] for x in D.Searcher(items, 80, 8).search([" ".join(a[:4] + ["x"] + a[5:]).encode()])] == [(0, 1, 1)]
