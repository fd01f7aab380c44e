"""BPE encoding and decoding of whole texts with a word-level vocabulary file.

Words (between white space) are encoded one by one and remembered.  A piece of a word that isn't split any further is
encoded by tree concatenation: its leaves of ``LEAF`` symbols are merged apart, and around each join a growing
window is encoded again until its first and its last token are those of the two sides; the tokens outside then
stand as they are.  (A sequence is the encoding of its text exactly if each adjacent pair of tokens is the
encoding of that pair's text, and each pair is then inside one of the three.)  Leaves and windows are so short that
most have been met before: they are remembered, too.

Texts of ``LONG_TEXT`` characters and more are not left to one task: parts of their long pieces are rows of their
own that all tasks encode in parallel; then each text is put together by the joins alone, once for all its copies.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

#: Symbols of a leaf, and of a part of a long text.
LEAF, PART = 12, 1024
LONG_TEXT = 1 << 16
#: Words, and leaves and windows, that a worker remembers, in each of two generations.
REMEMBERED, REMEMBERED_PARTS = 150_000, 100_000
#: Characters of pieces that are remembered, and of words: four times as many.
SHORT = 64
_SPACE = regex.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


#: Letters whose lower case depends on others, or isn't one letter.
_ODD = frozenset("Σİ")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter of each byte: printable ones stand for themselves, the others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Remember(dict):
    """Values by key; a miss is computed.  Keys not used for a generation are forgotten."""

    def __init__(self, compute: Callable, most: int = REMEMBERED) -> None:
        self.compute, self.most, self.old = compute, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def forget(self) -> None:
        self.old = {}
        self.clear()


class WordBpe:
    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        model, self.end = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"]).findall
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens: list[str] = [""] * size
        for token, i in (vocab | self.special).items():
            self.tokens[i] = token
        self.letters = _byte_letters()
        self.vocab = vocab
        #: by pair of ids: rank and id of what it merges into
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        #: symbols that a token is made of
        self.width = [len(t.removesuffix(self.end)) or 1 for t in self.tokens]
        self.words: _Remember = _Remember(self.word)
        self.short: _Remember = _Remember(self.piece)
        self.leaf: _Remember = _Remember(self.merge, REMEMBERED_PARTS)
        self.window: dict[tuple[int, int], list[int]] = {}

    def forget(self) -> None:
        """Workers live on after a task; what it has remembered need not."""
        for known in (self.words, self.short, self.leaf):
            known.forget()
        self.window.clear()

    def symbols(self, piece: str) -> list[int]:
        """Ids of a piece's letters; the last ends the word."""
        s = piece if piece.isascii() and piece.isalnum() else piece.encode().decode("latin-1").translate(self.letters)
        ids = [self.vocab.get(c) for c in s[:-1]] + [self.vocab.get(s[-1] + self.end)]
        return [i for i in ids if i is not None]

    def merge(self, ids: tuple[int, ...] | list[int]) -> list[int]:
        """The pair of least rank is merged, the leftmost first, until none is left."""
        ids, none, known = list(ids), (1 << 60, 0), self.merges.get
        ranks = [known(p, none) for p in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) is not none:
            k = ranks.index(best)
            ids[k : k + 2] = [best[1]]
            del ranks[k]
            if k:
                ranks[k - 1] = known((ids[k - 1], ids[k]), none)
            if k < len(ranks):
                ranks[k] = known((ids[k], ids[k + 1]), none)
        return ids

    def tree(self, symbols: list[int], parts: list[list[int]] | None = None, size: int = LEAF) -> list[int]:
        """Encoding of unsplit text.  ``parts``: the encodings of its parts of ``size`` symbols, if they are known."""
        if parts is None:
            parts = [self.leaf[tuple(symbols[k : k + size])] for k in range(0, len(symbols), size)]
        at = range(0, len(symbols), size)
        while len(parts) > 2:
            joined = [self.join(symbols, at[k + 1], parts[k], parts[k + 1]) for k in range(0, len(parts) - 1, 2)]
            parts, at = joined + parts[2 * len(joined) :], at[::2]
        return self.join(symbols, at[1], *parts) if len(parts) > 1 else parts[0]

    def join(self, symbols: list[int], mid: int, a: list[int], b: list[int]) -> list[int]:
        n = 1
        while True:
            left, right = a[-n:], b[:n]
            # the two tokens at a join are often ones that have met before
            window = self.window.get((left[0], right[0])) if n == 1 else None
            if window is None:
                start = mid - sum(map(self.width.__getitem__, left))
                stop = mid + sum(map(self.width.__getitem__, right))
                window = self.merge(symbols[start:stop])
                if n == 1:
                    if len(self.window) >= REMEMBERED_PARTS:
                        self.window.clear()
                    self.window[left[0], right[0]] = window
            if (n >= len(a) or window[0] == left[0]) and (n >= len(b) or window[-1] == right[-1]):
                return a[:-n] + window + b[n:]
            n *= 2

    def piece(self, piece: str) -> tuple[int, ...]:
        symbols = self.symbols(piece)
        return tuple(self.tree(symbols) if len(symbols) > LEAF else self.merge(symbols))

    def split(self, word: str) -> list[str | int]:
        """Pieces of a word without white space; special tokens are ids."""
        parts: list[str | int] = []
        at = 0
        for m in self.specials.finditer(word) if self.specials and "<" in word else ():
            parts += [*self._normal(word[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return parts + self._normal(word[at:])

    def _normal(self, text: str) -> list[str]:
        # lower-casing goes letter by letter, so a final sigma is no exception
        return self.pieces(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()) if text else []

    def word(self, word: str) -> tuple[int, ...]:
        core = word.rstrip(".,;:!?")
        if len(word) <= SHORT and core.isalpha() and (core.isascii() or unicodedata.is_normalized("NFC", core) and not _ODD.intersection(core)):
            # letters, which are one piece, and marks, which are another
            return self.short[core.lower()] + self.short[word[len(core) :]] if len(core) < len(word) else self.short[core.lower()]
        out: list[int] = []
        for p in self.split(word):
            out += (p,) if isinstance(p, int) else self.short[p] if len(p) <= SHORT else self.piece(p)
        return tuple(out)

    def split_words(self, text: str) -> list[str]:
        # str.split also splits at four control characters that aren't white space
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [w for w in _SPACE.split(text) if w]
        return text.split()

    def encode(self, text: str) -> list[int]:
        known = self.words
        words = self.split_words(text)
        return list(chain.from_iterable(map(known.__getitem__, words) if max(map(len, words), default=0) <= 4 * SHORT else (known[w] if len(w) <= 4 * SHORT else self.word(w) for w in words)))

    def decode(self, ids: list[int]) -> str:
        """As the library without a decoder: tokens, special ones too, with spaces between."""
        return " ".join(map(self.tokens.__getitem__, ids))


_MODELS: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """Once for each worker."""
    if path not in _MODELS:
        _MODELS[path] = WordBpe(path)
    return _MODELS[path]


_SCHEMA = "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string"


def _row(bpe: WordBpe, ids: list[int], with_ids: bool) -> tuple:
    packed = np.array(ids, "<u4").tobytes()
    return len(ids), packed if with_ids else None, hashlib.sha256(packed).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()


def _batch(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    n, packed, a, b = zip(*rows)
    return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(packed, pa.binary()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])


def _encode(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield _batch(part.column(0), [_row(bpe, bpe.encode(t.as_py() or ""), with_ids) for t in part.column(1)])
        bpe.forget()

    return run


def _long_pieces(bpe: WordBpe, text: str) -> Iterator[tuple[int, list[int]]]:
    """Number and symbols of the pieces that are longer than a part, in order."""
    n = 0
    for w in bpe.split_words(text):
        for p in bpe.split(w) if len(w) > PART // 4 else ():  # a character has four symbols at most
            if not isinstance(p, int) and len(symbols := bpe.symbols(p)) > PART:
                yield n, symbols
                n += 1


def _cut(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for n, symbols in _long_pieces(bpe, text.as_py()):
                    parts = [symbols[k : k + PART] for k in range(0, len(symbols), PART)]
                    columns = [key] * len(parts), [n] * len(parts), range(len(parts)), parts
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int32())))], ["key", "piece", "part", "symbols"])

    return run


def _merge(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                merged = pa.array([bpe.tree(s) for s in part.column(3).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], merged], ["key", "piece", "part", "ids"])
        bpe.forget()

    return run


def _assemble(path: str, with_ids: bool):
    def one(bpe: WordBpe, text: str, parts: list[dict]) -> list[int]:
        known: dict[int, list[list[int]]] = {}
        for x in sorted(parts, key=lambda x: (x["piece"], x["part"])):
            known.setdefault(x["piece"], []).append(x["ids"])
        out: list[int] = []
        n = 0
        for w in bpe.split_words(text):
            if len(w) <= PART // 4:
                out += bpe.words[w]
                continue
            for p in bpe.split(w):
                if isinstance(p, int):
                    out.append(p)
                elif len(symbols := bpe.symbols(p)) > PART:
                    out += bpe.tree(symbols, known[n], PART)
                    n += 1
                else:
                    out += bpe.piece(p)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                made = _batch(pa.array([0], pa.int64()), [_row(bpe, one(bpe, row.column(1)[0].as_py(), row.column(2)[0].as_py() or []), with_ids)])
                yield pa.RecordBatch.from_arrays([row.column(0), *made.columns[1:]], ["key", *made.schema.names[1:]])
        bpe.forget()

    return run


def bpe_encode(docs: DataFrame, path: str, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text", long_text: int = LONG_TEXT) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), ids_sha256 and decoded_sha256 of each whole text.

    ``path``: a tokenizers file with an end-of-word suffix, readable on every executor.  No special tokens are
    added; those that stand in a text are encoded as such.  A null or empty text has no tokens.  Null ids pass
    through, repeated rows are encoded alike, an empty table gives an empty result, other columns are not
    looked at.  A very long text is encoded whole, with the same result: it is cut into parts, and only its joins,
    and what one row holds, are one task's.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    is_long = F.coalesce(F.length("text") >= long_text, F.lit(False))
    short = texts.where(~is_long).mapInArrow(_encode(path, with_ids), _SCHEMA)
    # so few bytes would be put together into one task, so the numbers of partitions are given
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    long = texts.where(is_long).select("doc_id", "text", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("key"))
    distinct = scratch.table(long.select("key", "text").dropDuplicates(["key"]), "bpe-long")
    parts = distinct.mapInArrow(_cut(path), "key binary, piece long, part long, symbols array<int>").repartition(tasks, "key", "piece", "part")
    parts = parts.mapInArrow(_merge(path), "key binary, piece long, part long, ids array<int>").groupBy("key").agg(F.collect_list(F.struct("piece", "part", "ids")).alias("parts"))
    whole = distinct.join(parts, "key", "left").select("key", "text", "parts").repartition(tasks, "key").mapInArrow(_assemble(path, with_ids), _SCHEMA.replace("doc_id long", "key binary"))
    return short.union(long.select("doc_id", "key").join(scratch.apart(whole), "key").drop("key"))


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = [bpe.decode(np.frombuffer(x.as_py() or b"", "<u4").tolist()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of ``bpe_encode``'s doc_id and ids; null ids give an empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path), "doc_id long, text string")
