"""BPE and token counts against the public libraries."""

import hashlib
import random

import numpy as np
import pytest
from awkward import ROWS, documents, empty
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer, models  # noqa: E402

from shapeloom.llm import bpe as B  # noqa: E402
from shapeloom.llm import token_counts as C  # noqa: E402

PATH, PIECES = P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")
LIBRARY, OWN = Tokenizer.from_file(PATH), B.load(PATH)


def same(text):
    got, want = OWN.encode(text), LIBRARY.encode(text, add_special_tokens=False).ids
    assert got == want, text
    assert OWN.decode(got) == LIBRARY.decode(want, skip_special_tokens=False)


ODD = ["İstanbul ΣΑΣ ς", "a<|endoftext|>b <|startoftext|>", "é ́x", "\x1ca\x1db it's don't they'LL", " x y", "", "\n\n", "'s 're'", "ﬁ ½ Ⅷ ２", "👍🏽 é ñ̃", "\x00\x01a", "ǅ ß ẞ", "a\xadb", "漢字 かな", "a　b c"]


@pytest.mark.parametrize("text", ODD)
def test_odd(text):
    same(text)


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from([*"aethns é1'.İΣß<\n漢", "́", "the", "<|endoftext|>", "ing", "'s"]), max_size=40).map("".join))
def test_any(text):
    same(text)


def test_long_unsplit():
    """Tree concatenation gives what merging the whole at once gives."""
    rng = random.Random(1)
    for _ in range(400):
        parts = rng.choice([["a", "b"], list("etaoin"), ["the", "an"], ["a"], ["aaa", "b"], list("漢字é"), list("!?."), ["ation", "er", "x"]])
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(2, 700)))
        same(text)
        symbols = OWN.symbols(text.lower()) if text.isalpha() else None
        if symbols and len(symbols) < 400:
            assert OWN.tree(symbols) == OWN.merge(symbols)


@pytest.mark.parametrize("long_text", [B.LONG_TEXT, 1, 12])
def test_encode(spark, long_text):
    """Also with all texts taken for long ones, whose leaves are encoded apart."""
    rows = [*ROWS, *((100 + k, t, "en") for k, t in enumerate([*ODD, "q" * 300 + "<|endoftext|>" + "ab" * 200 + " " + "é" * 90]))]
    encoded = B.bpe_encode(documents(spark, rows), PATH, long_text=long_text)
    want = []
    for i, t, _ in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        want.append(repr((i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest(), packed)))
    assert sorted(repr((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, bytes(r.ids))) for r in encoded.collect()) == sorted(want)
    texts = sorted(repr((r.doc_id, r.text)) for r in B.bpe_decode(encoded, PATH).collect())
    assert texts == sorted(repr((i, LIBRARY.decode(LIBRARY.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False))) for i, t, _ in rows)


def test_encode_empty(spark):
    assert B.bpe_encode(empty(spark), PATH).count() == 0


def test_remember_forgets():
    calls = []
    r = B._Remember(lambda k: calls.append(k) or k * 2, most=2)
    assert [r[k] for k in (1, 2, 1, 3, 1, 4, 5, 1)] == [2, 4, 2, 6, 2, 8, 10, 2] and len(r) <= 2


SCORES = C.unigram_scores(PIECES)
UNIGRAM = models.Unigram([("<unk>", -1000.0), *SCORES.items()], 0, False)
TRIE = C.CountingTrie(SCORES)


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from([*"aethnsé1.,", "the", "ing", "ation"]), max_size=14).map("".join))
def test_counts_are_the_library_s(word):
    TRIE.clear()
    tokens, score = TRIE.insert(C.MARK + word)
    pieces = [t.value for t in UNIGRAM.tokenize(C.MARK + word)]
    assert tokens == len(pieces) and score == pytest.approx(sum(SCORES[p] for p in pieces))


def best(word, scores, byte):
    """Plain dynamic programming, for one word."""
    at = [(0.0, 0)]
    for d in range(1, len(word) + 1):
        n = len(word[d - 1].encode())
        choices = [(at[d - 1][0] + n * byte, -at[d - 1][1] - n)]
        choices += [(at[k][0] + scores[word[k:d]], -at[k][1] - 1) for k in range(d) if word[k:d] in scores]
        s, t = max(choices)
        at.append((s, -t))
    return at[-1][1], at[-1][0]


def test_trie_shares_prefixes():
    rng = random.Random(2)
    trie = C.CountingTrie(SCORES, nodes=500)  # also starts anew
    for _ in range(2000):
        w = C.MARK + "".join(rng.choice(["th", "e", "an", "漢", "😀", "x", "ing"]) for _ in range(rng.randrange(0, 8)))
        tokens, score = trie.insert(w)
        assert (tokens, pytest.approx(score)) == best(w, SCORES, trie.byte)
    shared = C.CountingTrie(SCORES)
    shared.insert("abcdef")
    before = len(shared.forward)
    shared.insert("abcdeg")
    assert len(shared.forward) == before + 1


def test_long_pre_tokens(monkeypatch):
    rng = random.Random(3)
    for _ in range(300):
        w = C.MARK + "".join(rng.choice(["th", "e", "an", "漢", "😀", "x", "ing", "ation"]) for _ in range(rng.randrange(0, 40)))
        TRIE.clear()
        whole = TRIE.insert(w)
        monkeypatch.setattr(C, "DEPTH", rng.randrange(1, 30))
        TRIE.clear()
        assert TRIE.insert(w) == pytest.approx(whole)
        assert len(TRIE.forward) <= C.DEPTH + 1
        monkeypatch.undo()


def test_count_documents(spark):
    trie = C.CountingTrie(SCORES)
    got = {r.doc_id: r for r in C.token_counts(documents(spark), PIECES).collect() if r.doc_id is not None}
    for i, t, _ in ROWS:
        if i is not None:
            counts = [trie.insert(C.MARK + w) for w in (t or "").split()]
            assert (got[i].n_words, got[i].n_tokens) == (len(counts), sum(c for c, _ in counts)) and got[i].log_prob == pytest.approx(sum(s for _, s in counts))
    assert C.token_counts(empty(spark), PIECES).count() == 0
