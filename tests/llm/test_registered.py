"""The registered queries over small tables with everything that can go wrong, against SQL or plain versions."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from awkward import LONG

from shapeloom.llm import langid
from shapeloom.llm import license_scan as L
from shapeloom.llm import pii
from shapeloom.llm.queries import QUERIES, SQL, vocabulary

UNSPLIT = "".join(random.Random(1).choice(["the", "ation", "e", "rs", "漢", "xq"]) for _ in range(30_000))  # some 100 KB
PASSAGE = " ".join(f"word{k}" for k in range(20))
DOCUMENTS = [
    (1, "Hello World again and again", "en"), (2, "hello world AGAIN and again", "en"), (3, None, "en"), (4, "", None), (5, LONG, "en"), (6, LONG, "de"), (None, "hello world again and again", "en"), (None, None, None),
    (7, "Ünï çødé ÜNÏ", "de"), (7, "Ünï çødé ÜNÏ", "de"), (8, "ünï çødé ÜNÏ", None), (9, "!!! 123", "de"), (10, "one", "en"), (11, "ONE two", "en"), (11, "another text with the id eleven", "en"), (None, "no id, no copy", "en"), (None, "no id, no copy", "en"),
    (12, f"see {PASSAGE.upper()}, end", "en"), (13, PASSAGE.replace("word7", "changed"), "en"), (14, UNSPLIT, "en"), (15, UNSPLIT, None), (16, "x " + UNSPLIT[:70_000] + " y", "en"),
    (17, "The GNU General Public License, MIT license. CC BY, cc by; Apache Licence and mit lisense", "en"), (18, "mail a.b@c.org, 1.2.3.4 or 300.1.1.1, 4111 1111 1111 1111, +1 (555) 123-4567; IBAN: DE89370400440532013000 and token = 'abcd1234efgh'", "en"),
    *((100 + k, " ".join(random.Random(k).choices(["the", "and", "house", "tree", "walks", "river"], k=20)), "en") for k in range(40)), *((200 + k, " ".join(random.Random(k).choices(["der", "und", "haus", "baum", "geht", "fluß"], k=20)), "de") for k in range(40)),
]
PAGES = [(1, "http://a.com/x", "same"), (2, None, "same"), (3, "http://www.example.com/en/1", None), (4, "u://x.net/es/", ""), (None, "https://M.Example.com/en/?q", "same"), (6, "u", "only"), (6, "u", "only"), (None, "", "alone"), (None, "x", "alone"), (7, "a://b.net/fr/#", "ß" * 99_999)]
BENCHMARK = [(1, PASSAGE), (1, "another item of this id, which no document has at all"), (2, None), (None, PASSAGE), (3, "one"), (4, "")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    documents = [(i, t, lang, f"s{k}", len(t or "")) for k, (i, t, lang) in enumerate(DOCUMENTS)]
    for name, rows, schema in (("documents", documents, "doc_id long, text string, lang string, source string, n_chars long"), ("pages", PAGES, "page_id long, url string, html string"), ("benchmark", BENCHMARK, "item_id long, text string")):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"file://{path}/{name}.parquet")
    return path


@pytest.fixture(scope="module")
def rows(spark, folder):
    return lambda name: QUERIES[name](spark, f"file://{folder}").collect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_agrees(spark, folder, rows, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    wanted = c.sql(SQL[name])
    got = rows(name)
    names = sorted(wanted.columns)
    assert sorted(repr([r[k] for k in names]) for r in got) == sorted(repr([dict(zip(wanted.columns, r))[k] for k in names]) for r in wanted.fetchall())


def by_text(got, compute):
    """Rows of ``got`` and what a plain version makes of each document, as one sorted list each."""
    assert sorted(map(repr, got)) == sorted(repr((i, *compute(t or ""))) for i, t, _ in DOCUMENTS)


def test_op6(rows):
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary("word_bpe_49k.json"))

    def plain(text):
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tokenizer.decode(ids, skip_special_tokens=False).encode())

    by_text([(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows("op6_bpe")], plain)


def test_op3(rows):
    from tokenizers import Tokenizer, models, pre_tokenizers

    from shapeloom.llm.token_counts import MARK, unigram_scores

    scores = unigram_scores(vocabulary("piece_bpe_32k.model"))
    library = Tokenizer(models.Unigram([("<unk>", -1000.0), *scores.items()], 0, False))
    library.pre_tokenizer = pre_tokenizers.Metaspace(MARK, prepend_scheme="never")
    single = {p for p in scores if len(p) == 1}

    def plain(text):
        words = text.split()
        return len(words), sum(len(library.encode(MARK + w).ids) for w in words)

    known = [i for i, t, _ in DOCUMENTS if i is not None and not set("".join((t or "").split())) - single]
    assert len(known) > 80
    wanted = sorted((i, *plain(t or "")) for i, t, _ in DOCUMENTS if i in known)
    assert sorted((r.doc_id, r.n_words, r.n_tokens) for r in rows("op3_token_counts") if r.doc_id in known) == wanted


def test_op5(rows):
    found = sorted((r.doc_id, r.item_id, r.edits, r.item_words) for r in rows("op5_decontamination"))
    assert found == [(10, 3, 0, 1), (11, 3, 0, 1), (12, 1, 0, 20), (13, 1, 1, 20)]


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def test_op9(rows):
    def plain(text):
        w = words(text)
        at = [(k, label) for p, label in PHRASES.items() for q in [p.split()] for k in range(len(w)) if w[k : k + len(q)] == q]
        starts = [k for k, _ in at]
        return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))

    got = rows("op9_license_scan")
    by_text([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], plain)
    for r in got:
        assert set(r.base_labels.split(",")) <= {*r.labels.split(","), ""} and r.labels.split(",") == sorted(set(r.labels.split(",")))
        assert r.score == 1 if r.n_base else 0 <= r.score <= 1 and bool(r.labels) == (r.score > 0)
    assert {r.doc_id: (r.labels, r.first_word, r.last_word) for r in got}[17] == ("apache,cc-by,gpl,mit", 1, 9)
    assert len(L.NOTICES) > 40


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, s):
    d = [int(c) for c in s if c in "0123456789"]
    luhn = sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d))) % 10 == 0
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in s.split(".")), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]


def test_op10(rows):
    def base(text):
        return [(k, m.start(), m.end()) for k, p in PATTERNS.items() if k != "email" or "@" in text for m in re.finditer(p, text) if valid(k, m[0])]

    def plain(text):
        found = base(text)
        return *(sum(k == kind for k, *_ in found) for kind in PATTERNS), hashlib.sha256(",".join("%s:%d:%d" % s for s in found).encode()).hexdigest()

    got = rows("op10_pii")
    by_text([(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got], plain)
    texts = {i: t or "" for i, t, _ in DOCUMENTS}
    for r in got:
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        if r.doc_id == 18:
            assert [s for s in spans if s[0] in PATTERNS] == base(texts[18])
            assert [texts[18][a:b] for k, a, b in spans if k not in PATTERNS] == ["DE89370400440532013000", "abcd1234efgh"]


def test_op1(spark, folder, rows):
    got = rows("op1_language_id")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    assert sorted(repr((r.doc_id, r.held_out)) for r in got) == sorted(repr((i, held(i))) for i, *_ in DOCUMENTS)
    assert all((r.lang_pred == "und") == (r.score == 0) and r.lang_pred in ("en", "de", "und") and 0 <= r.score <= 1 for r in got)
    made = [r for r in got if r.doc_id and r.doc_id >= 100]
    assert sum(r.lang_pred == ("en" if r.doc_id < 200 else "de") for r in made if r.held_out) == sum(r.held_out for r in made) > 10
    # the same model, applied by loops
    model = langid.train(spark.read.parquet(f"file://{folder}/documents.parquet").where(~langid.held_out()))
    wanted = []
    for i, t, _ in DOCUMENTS:
        pred, score = plainly(model, t)
        wanted.append((i, pred, round(score, 5)))
    assert sorted(repr((r.doc_id, r.lang_pred, round(r.score, 5))) for r in got) == sorted(map(repr, wanted))


def plain_features(text):
    """Feature by feature, in Python's own integers."""
    letters = []
    for c in f" {text or ''} ".lower():
        if c.isalpha():
            letters.append(ord(c))
        elif not letters or letters[-1] != 32:
            letters.append(32)
    counts = {}
    if any(c != 32 for c in letters):
        h = [0] * len(letters)
        for n in range(3):
            h = [((h[k] + letters[k + n]) * 0x9E3779B1 + n) & 0xFFFFFFFF for k in range(len(letters) - n)]
            h = [x ^ x >> 15 for x in h]
            for x in h:
                f = (x * 0x85EBCA6B & 0xFFFFFFFF) >> 17
                counts[f] = counts.get(f, 0) + 1
    return counts


def plainly(model, text):
    counts = plain_features(text)
    if not counts:
        return "und", 0.0
    v = {f: (1 + np.log(n)) * model.idf[f] for f, n in counts.items()}
    norm = sum(x * x for x in v.values()) ** 0.5
    logits = [(sum(x / norm * float(model.weights[f, k]) for f, x in v.items()) + float(model.bias[k])) / model.temperature for k in range(len(model.languages))]
    e = [np.exp(x - max(logits)) for x in logits]
    best = int(np.argmax(e))
    return model.languages[best], float(e[best] / sum(e))
