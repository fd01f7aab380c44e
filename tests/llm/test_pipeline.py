"""The pipeline against plain code on a small corpus, and the registered queries against SQL."""

import os
import random
import zlib

import pytest
from awkward import documents, empty
from pyspark.sql import functions as F
from test_decontaminate import distance, words
from test_exact_dedup import low
from test_near_dup import brute as near_brute
from test_queries import compare

import corpus_pipeline as C
from shapeloom.llm import decontaminate as D
from shapeloom.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(5)
    syllables = {"aa": ["ba", "du", "mi", "so"], "bb": ["stra", "zek", "or", "ul"]}
    text = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    items = [(k, text("aa", 30)) for k in range(5)]
    rows = [(k, text(lang, rng.randrange(30, 80)), lang) for k in range(150) for lang in [rng.choice(["aa", "bb"])]]
    rows += [(200 + k, rows[k % 20][1].upper() if k % 2 else rows[k % 20][1], "aa") for k in range(30)]  # equal
    rows += [(300 + k, rows[k][1] + " so", "aa") for k in range(20, 40)]  # near
    rows += [(400 + k, rows[k][1] + " " + items[k % 5][1], "aa") for k in range(40, 55)]  # leaks
    rows += [(500, None, "aa"), (501, "", "aa"), (502, "123 !", "bb"), (200, rows[150][1], "aa"), (None, rows[0][1], "aa"), (None, text("aa", 20) + items[0][1], "aa")]
    path = tmp_path_factory.mktemp("sf")
    documents(spark, rows).repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), rows, items


def test_stages(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    got = {}
    for name, stage in C.STAGES[:-1]:
        out = C.scratch.table(stage(spark, docs, path), "test")
        assert out.columns == docs.columns
        docs, got[name] = out, sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    key = lambda rs: sorted(((i, t) for i, t, *_ in rs), key=repr)

    lettered = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    assert got["language ID"] == key(lettered)

    last = {}
    for i, t, _ in lettered:
        if i is not None:
            last[low(t)] = max(i, last.get(low(t), i))
    named = {(i, low(t)): (i, t) for i, t, _ in lettered if i is not None and last[low(t)] == i}
    exact = [*named.values(), *((i, t) for i, t, _ in lettered if i is None)]
    assert got["exact dedup"] == key(exact)

    near = {eval(x)[0] for x in near_brute(exact, C.WIDTH, C.PERCENT) if eval(x)[3]}
    kept = [(i, t) for i, t in exact if i in near]
    assert got["near dedup"] == key(kept) and len(kept) < len(exact)

    leaks = lambda t: any(distance(words(x), words(t)) <= D.allowed(len(words(x)), 80) for _, x in items)
    clean = [(i, t) for i, t in kept if not leaks(t)]
    assert got["benchmark decontamination"] == key(clean) and len(clean) < len(kept)

    encoded = C.STAGES[-1][1](spark, docs, path)
    assert sorted(r.doc_id or -1 for r in encoded.collect()) == sorted(i or -1 for i, _ in clean)


def test_run(spark, folder):
    out = C.run(spark, folder[0])
    assert out.count() > 50 and "ids" in out.columns


def test_empty(spark, folder):
    docs = empty(spark)
    for _, stage in C.STAGES:
        assert stage(spark, docs, folder[0]).count() == 0


def test_unlearned_scripts_and_even_scores_are_rejected(spark, folder, monkeypatch):
    path, rows, _ = folder
    foreign = ["Съешь же ещё этих мягких французских булок", "这是一个没有学过的语言的句子", "これは学んでいない言語の文です", "שלום עולם"]
    held = [k for k in range(1000, 1200) if zlib.crc32(str(k).encode()) % 4 == 2]
    docs = documents(spark, [*rows, *((k, t, "zz") for k, t in zip(held, foreign)), (held[9], "Съешь badu miso baba", "aa")])
    kept = lambda: {r.doc_id for r in C.language_stage(spark, docs, path).collect()}
    assert kept() == {i for i, t, _ in rows if t and any(c.isalpha() for c in t)} | {held[9]}
    # an even score of two languages, whatever the text
    monkeypatch.setattr(C, "LEAST_KNOWN", 0.0)
    monkeypatch.setattr(C, "predict", lambda docs, model, pred_col, score_col, least_known: docs.withColumns({pred_col: F.lit("aa"), score_col: F.lit(0.52)}))
    assert not kept()


def test_least_score_follows_the_number_of_languages():
    assert [round(C.least_score(n), 3) for n in (1, 2, 3, 4)] == [1, 0.533, 0.378, 0.3]


def test_items_without_an_id(spark, tmp_path):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    spark.createDataFrame([(None, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = documents(spark, [(1, f"x {item} y", "en"), (2, "a clean text", "en")])
    assert [r.doc_id for r in C.benchmark_stage(spark, docs, str(tmp_path)).collect()] == [2]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_matches_sql(spark, name):
    compare(spark, Q.QUERIES[name], Q.SQL[name])
