import os
import random
import zlib

import numpy as np
import pytest
from awkward import ROWS, documents, empty
from pyspark.sql import functions as F

from shapeloom.llm import langid as G

SF = "/root/testdata/sf0.001"
SYLLABLES = {"aa": ["ba", "du", "mi"], "bb": ["stra", "zek", "or"], "cc": ["ño", "qui", "la"]}


def corpus(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lang = rng.choice(list(SYLLABLES))
        rows.append((k, " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 40))), lang))
    return rows


def test_held_out_rows_are_predicted_and_not_learned(spark):
    rows = corpus(400)
    lied = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    out = {r.doc_id: r for r in G.language_id(documents(spark, lied)).collect()}
    assert all(out[i].lang_pred == lang for i, _, lang in rows) and all(0 <= r.score <= 1 for r in out.values())
    assert {i for i, r in out.items() if r.held_out} == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2}


def test_predictions_depend_on_the_text_alone(spark):
    rows = corpus(200)
    df = documents(spark, rows)
    model = G.train(df)
    other = df.select(F.lit(7).alias("doc_id"), "text", F.lit("aa").alias("lang"))
    a, b = (sorted(repr((r.text, r.p, r.s)) for r in G.predict(d, model, pred_col="p", score_col="s").collect()) for d in (df, other))
    assert a == b
    # the sample's order and partitions make no difference
    again = G.train(df.repartition(5))
    assert np.array_equal(model.weights, again.weights) and model.temperature == again.temperature
    assert 0 < (model.weights == 0).mean() < 1


def test_awkward(spark):
    out = {(r.doc_id, r.lang_pred) for r in G.language_id(documents(spark, ROWS + corpus(80, 2))).select("doc_id", "lang_pred").collect()}
    assert {(3, "und"), (4, "und"), (9, "und")} <= out and {i for i, p in out if p == "und"} <= {3, 4, 9, None}
    assert G.language_id(empty(spark)).count() == 0
    nobody = documents(spark, [(1, "text", None), (2, None, "en")])
    assert {(r.lang_pred, r.score) for r in G.language_id(nobody).collect()} == {("und", 0.0)}


def test_ftrl_against_plain_loops():
    """One coordinate after the other, written as the formula stands."""
    rng = np.random.default_rng(3)
    f, z, n = G.Ftrl(6, 3), np.zeros((7, 3)), np.zeros((7, 3))
    for _ in range(30):
        at = np.sort(rng.choice(6, 3, replace=False))
        v, label = rng.random(3), int(rng.integers(3))
        f.learn(at, v, label)
        x = [*zip(at.tolist(), v.tolist()), (6, 1.0)]
        w = {(i, c): 0.0 if abs(z[i, c]) <= (l1 := G.L1 * (i < 6)) else -(z[i, c] - np.sign(z[i, c]) * l1) / ((G.BETA + n[i, c] ** 0.5) / G.ALPHA + G.L2 * (i < 6)) for i, _ in x for c in range(3)}
        s = np.array([sum(w[i, c] * a for i, a in x) for c in range(3)])
        p = np.exp(s) / np.exp(s).sum()
        for i, a in x:
            for c in range(3):
                g = (p[c] - (c == label)) * a
                z[i, c] += g - ((n[i, c] + g * g) ** 0.5 - n[i, c] ** 0.5) / G.ALPHA * w[i, c]
                n[i, c] += g * g
    assert np.allclose(f.z, z) and np.allclose(f.n, n)


def test_features():
    at, counts = G.features("Ab, ab! 1")
    assert counts.sum() == 7 + 6 + 5 and (at < G.BUCKETS).all()  # of " ab ab "
    long = "ab cd " * 3000
    a, b = G.features(long), np.unique(np.concatenate([np.repeat(x, c) for x, c in zip(*G.features(long))]), return_counts=True)
    assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1])


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = G.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    right, n = out.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 20 and right > 0.95


def test_more_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(G, "LANGUAGES", 3)
    assert G.train(documents(spark, [(k, "ab", f"l{k}") for k in range(3)])).languages == ["l0", "l1", "l2"]
    with pytest.raises(ValueError, match="lang has more than 3 distinct values"):
        G.train(documents(spark, [(k, "ab", f"l{k}") for k in range(4)]))
