"""License notices, exact and with a few edits.

Texts are reduced to lower-case words joined by single spaces.  A notice that may differ by k edits is cut
into k + 1 pieces, one of which must occur unchanged (pigeonhole).  One automaton of all pieces tells which notices a
text can have at all; the places of these notices' pieces are the candidates, and the regex library's bounded-error matching verifies the text from each word that a candidate may
begin with, up to the end of a word, and reports the span with its number of edits.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: ASCII letters and digits and everything beyond ASCII belongs to words; A-Z are lower-cased.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


@dataclass(frozen=True)
class Notice:
    phrase: str
    label: str
    edits: int  #: that a place may differ by


NOTICES = (
    Notice("gnu general public license", "gpl", 3),
    Notice("apache license", "apache", 2),
    Notice("cc by", "cc-by", 0),
    Notice("mit license", "mit", 1),
    Notice("creative commons attribution", "cc-by", 3),
    Notice("mozilla public license", "mpl", 3),
    Notice("bsd license", "bsd", 1),
    # families and variants
    Notice("gnu lesser general public license", "lgpl", 3),
    Notice("gnu library general public license", "lgpl", 3),
    Notice("gnu affero general public license", "agpl", 3),
    Notice("gnu free documentation license", "gfdl", 3),
    Notice("2 clause bsd", "bsd-2-clause", 0),
    Notice("bsd 2 clause", "bsd-2-clause", 0),
    Notice("simplified bsd license", "bsd-2-clause", 2),
    Notice("3 clause bsd", "bsd-3-clause", 0),
    Notice("bsd 3 clause", "bsd-3-clause", 0),
    Notice("new bsd license", "bsd-3-clause", 1),
    Notice("isc license", "isc", 0),
    Notice("eclipse public license", "epl", 2),
    Notice("european union public licence", "eupl", 3),
    Notice("common public license", "cpl", 2),
    Notice("common development and distribution license", "cddl", 3),
    Notice("microsoft public license", "ms-pl", 2),
    Notice("microsoft reciprocal license", "ms-rl", 2),
    Notice("apple public source license", "apsl", 2),
    Notice("boost software license", "bsl", 2),
    Notice("business source license", "busl", 2),
    Notice("server side public license", "sspl", 2),
    Notice("artistic license", "artistic", 1),
    Notice("academic free license", "afl", 2),
    Notice("open software license", "osl", 2),
    Notice("zlib license", "zlib", 1),
    Notice("openssl license", "openssl", 1),
    Notice("php license", "php", 0),
    Notice("postgresql license", "postgresql", 1),
    Notice("python software foundation license", "psf", 3),
    Notice("universal permissive license", "upl", 2),
    Notice("mulan permissive software license", "mulan", 2),
    Notice("sil open font license", "ofl", 2),
    Notice("open database license", "odbl", 2),
    Notice("open data commons attribution license", "odc-by", 3),
    Notice("do what the fuck you want to public license", "wtfpl", 3),
    Notice("the unlicense", "unlicense", 1),
    Notice("cc by sa", "cc-by-sa", 0),
    Notice("cc by nc", "cc-by-nc", 0),
    Notice("cc by nd", "cc-by-nd", 0),
    Notice("cc by nc sa", "cc-by-nc-sa", 0),
    Notice("cc by nc nd", "cc-by-nc-nd", 0),
    Notice("cc0", "cc0", 0),
    Notice("creative commons zero", "cc0", 2),
    Notice("creative commons attribution sharealike", "cc-by-sa", 3),
    Notice("creative commons attribution share alike", "cc-by-sa", 3),
    Notice("creative commons attribution noncommercial", "cc-by-nc", 3),
    Notice("creative commons attribution noderivatives", "cc-by-nd", 3),
    # opening words of the texts themselves
    Notice("permission is hereby granted free of charge to any person obtaining a copy", "mit", 5),
    Notice("permission to use copy modify and or distribute this software for any purpose", "isc", 5),
    Notice("redistribution and use in source and binary forms with or without modification", "bsd", 5),
    Notice("this is free and unencumbered software released into the public domain", "unlicense", 5),
    Notice("free software foundation either version", "gpl", 3),
)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


class Scanner:
    def __init__(self, notices: tuple[Notice, ...] = NOTICES) -> None:
        self.notices = []
        pieces: dict[str, list[int]] = {}
        for number, n in enumerate(notices):
            p, k = n.phrase.encode(), n.edits + 1
            cuts = [len(p) * i // k for i in range(k + 1)]
            seeds = [(p[a:b], a) for a, b in zip(cuts, cuts[1:])]
            fuzzy = regex.compile(f"(?b)(?<= )(?:{regex.escape(n.phrase, literal_spaces=True)}){{e<={n.edits}}}(?= )") if n.edits else None
            self.notices.append((n, b" " + p + b" ", seeds, fuzzy))
            for seed, _ in seeds:
                pieces.setdefault(seed.decode(), []).append(number)
        self.pieces = ahocorasick.Automaton()
        for piece, numbers in pieces.items():
            self.pieces.add_word(piece, numbers)
        self.pieces.make_automaton()

    def scan(self, tokens: list[bytes]) -> list[tuple[str, str, int, int, int, str]]:
        """(label, phrase, first word, words, edits, matched text), ordered; exact places first, then those
        with edits that overlap no exact place of the same notice."""
        text = b" " + b" ".join(tokens) + b" "
        out = []
        spaces = None
        there: set[int] = set()
        if self.notices:
            for _, numbers in self.pieces.iter(text.decode()):
                there.update(numbers)
        for n, exact, seeds, fuzzy in (self.notices[k] for k in sorted(there)):
            spans: list[tuple[int, int]] = []  # sorted
            at, word, seen = text.find(exact), 0, 0
            while at >= 0:
                word, seen = word + text.count(b" ", seen, at), at
                out.append((n.label, n.phrase, word, exact.count(b" ") - 1, 0, n.phrase))
                spans.append((at + 1, at + len(exact) - 1))
                at = text.find(exact, at + 1)
            if fuzzy is None:
                continue
            places: dict[tuple[int, int], int] = {}
            tried: set[int] = set()
            reach = 4 * (len(n.phrase) + n.edits) + 2  # bytes: a character has four at most
            for seed, offset in seeds:
                at = text.find(seed)
                while at >= 0:
                    # where the notice begins but for its edits, which may have put in or taken out characters
                    start = at - offset
                    a = text.find(b" ", max(0, start - 4 * n.edits - 1), start + n.edits) + 1
                    while a:
                        k = bisect_left(spans, (a + 1, 0))
                        if a not in tried and not (k and a < spans[k - 1][1]):  # in no exact place
                            tried.add(a)
                            if m := fuzzy.match(text[a - 1 : a + reach].decode(errors="ignore"), 1):
                                places[a, a + len(m.group().encode())] = sum(m.fuzzy_counts)
                        a = text.find(b" ", a, start + n.edits) + 1
                    at = text.find(seed, at + 1)
            if places and spaces is None:
                spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
            for edits, (a, b) in sorted((e, ab) for ab, e in places.items()):
                # no span is longer than reach, so only those that begin in between can overlap
                near = spans[bisect_left(spans, (a - reach, 0)) : bisect_left(spans, (b, 0))]
                if not any(a < y and x < b for x, y in near):
                    insort(spans, (a, b))
                    word = int(np.searchsorted(spaces, a)) - 1
                    out.append((n.label, n.phrase, word, text.count(b" ", a, b) + 1, edits, text[a:b].decode()))
        return sorted(out, key=lambda x: (x[2], x[1]))


_HITS = "array<struct<label:string,phrase:string,first_word:bigint,n_words:bigint,edits:bigint,text:string>>"
_HIT = pa.list_(pa.struct([("label", pa.string()), ("phrase", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int64()), ("text", pa.string())]))
_FIELDS = ("label", "phrase", "first_word", "n_words", "edits", "text")


def _scan(notices: tuple[Notice, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)
        for batch in batches:
            n, hits = [], []
            for text in batch.column(1):
                tokens = words(text.as_py())
                n.append(len(tokens))
                hits.append([dict(zip(_FIELDS, h)) for h in scanner.scan(tokens)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(hits, _HIT)], ["doc_id", "n_words", "hits"])

    return run


def license_scan(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words and hits (label, phrase, first word, words, edits, matched text) of each whole text.

    A null or empty text has no words and no hits; a very long one is scanned whole.  Of places with edits that overlap
    the one with fewest stays, of equal ones the first; different notices may overlap.  Null ids pass through, repeated rows are scanned alike,
    an empty table gives an empty result, other columns are not looked at.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(_scan(notices), f"doc_id long, n_words long, hits {_HITS}")
