"""Benchmark passages in documents, with a share of their words edited.

Texts are words (letters and digits, lower-cased); in scripts that are written without spaces each character is
one.  The CGK embedding walks over a word sequence and, at each step, writes down the word it stands on and moves on
if a random bit of (step, word) says so; both sides of an edit soon walk in step again, so edit distance becomes
Hamming distance.  As many edits as are allowed here would leave little of one long walk in step, so an item is walked
in short walks from each of its words, and a document from each word of its windows.  A repetition samples some steps;
where a document's words at these are those of an item's walk, the item is a candidate at that alignment.

How long the walks of a class of items (of equally many edits) are, and how often they are repeated, follows from
copies of all its items with all edits allowed, in several patterns: they are as long as possible while ``recall`` of
the copies of each pattern are found.  A walk of s steps sees s words at most, and of an item of n words with k edits
some (n - k) / (k + 1) stand unchanged side by side, so walks of so many steps miss nothing: there is always a length,
and no cap on repetitions stands in the way.  Unchanged copies are always found.

Candidates whose words are too few of the item's are passed over; the others are verified by exact edit distance
(bit-parallel, on 64-bit word hashes, the item anywhere in the window and what edits can add to it).
"""

from __future__ import annotations

import logging
import re
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import hash_words, mix

#: Items, and bytes of their texts, searched for in one pass over the documents; more take further passes.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 8 << 20
#: Steps of a walk and steps sampled of them, the longest first.
WALKS = ((8, 5), (6, 4), (4, 3), (3, 2), (2, 2), (1, 1))
#: Repetitions of walks that may miss a copy: where more were needed, shorter walks are taken; and copies of a class on
#: which each pattern is measured, at least.
REPETITIONS, COPIES = 8, 400
#: Bytes of text at a time, and candidates at a time.
CHUNK, CANDIDATES = 2 << 20, 1 << 18
#: Characters of scripts without spaces (Thai to Tibetan, Myanmar, Khmer, Tai, Balinese, Javanese, kana, Chinese), and
#: the marks between them.
_SINGLE = re.compile("([\u0e00-\u109f\u1780-\u17ff\u1950-\u19ff\u1a20-\u1aaf\u1b00-\u1b7f\u3005-\u3007\u3040-\u312f\u31a0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua980-\ua9df\ua9e0-\ua9ff\uaa60-\uaadf\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff])")
_MARKS = re.compile("[\u3000-\u3004\u3008-\u3020\u3030\u303d\u30fb\ufe30-\ufe4f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")
_LOG = logging.getLogger(__name__)
_TABLE = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def normal(text: str | None) -> bytes:
    low = (text or "").lower()
    raw = low.encode()
    # below U+0800 there are no such scripts
    if not low.isascii() and np.frombuffer(raw, np.uint8).max() >= 0xE0:
        raw = _SINGLE.sub(r" \1 ", _MARKS.sub(" ", low)).encode()
    return raw.translate(_TABLE)


class Walks:
    """Walks of one length over items: their keys, the items they are of and where in these they begin."""

    def __init__(self, steps: int, sampled: int) -> None:
        self.steps = steps
        rng = np.random.default_rng([steps, sampled])
        self.bits = rng.integers(0, 1 << 32, (REPETITIONS, steps), np.uint32) | np.uint32(1)
        # the first and the last step always: the farther apart the words are, the more they tell
        self.sampled = [{0, steps - 1, *(1 + rng.choice(steps - 2, sampled - 2, replace=False)).tolist()} if sampled > 2 else {0, steps - 1} for _ in range(REPETITIONS)]
        self.last = steps - 1
        self.index: list[tuple[np.ndarray, ...]] = []

    def keys(self, r: int, known: np.ndarray, words: np.ndarray, at: np.ndarray, filters: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(begin, key) of the walks from ``at`` whose sampled words are all known (not 0); with ``filters`` only
        of those that are some item's as far as a few bits tell."""
        begin, key, n = at, np.zeros(len(at), np.uint64), 0
        for j in range(self.last + 1):
            if j in self.sampled[r]:
                w = known[at]
                key = mix(key * np.uint64(0x2545F4914F6CDD1D) + w)
                there = w != 0
                if filters is not None:
                    bits = filters[n]
                    there &= bits[key >> np.uint64(64 - (len(bits) - 1).bit_length())]
                begin, at, key, n = begin[there], at[there], key[there], n + 1
            if j < self.last:
                at = at + ((words[at] * self.bits[r, j]) >> np.uint32(31))
        return begin, key

    def build(self, of: np.ndarray, offset: np.ndarray, known: np.ndarray, words: np.ndarray, at: np.ndarray, repetitions: np.ndarray) -> None:
        """The index of the walks from ``at``, which are items' ``of`` at ``offset``; of each in its first ``repetitions``."""
        for r in range(int(repetitions.max(initial=0))):
            mine = repetitions > r
            number = np.flatnonzero(mine)
            filters, begin, key, cur = [], number, np.zeros(len(number), np.uint64), at[mine]
            size = 1 << max(10, (16 * max(1, len(number))).bit_length())
            for j in range(self.last + 1):
                if j in self.sampled[r]:
                    w = known[cur]
                    key = mix(key * np.uint64(0x2545F4914F6CDD1D) + w)
                    there = w != 0
                    begin, cur, key = begin[there], cur[there], key[there]
                    some = np.zeros(size, bool)
                    some[key >> np.uint64(64 - (size - 1).bit_length())] = True
                    filters.append(some)
                if j < self.last:
                    cur = cur + ((words[cur] * self.bits[r, j]) >> np.uint32(31))
            order = np.argsort(key, kind="stable")
            self.index.append((key[order], of[begin][order], offset[begin][order], filters))

    def hits(self, known: np.ndarray, words: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(begin, item, offset in the item) of walks from ``at`` that are an item's, about ``CANDIDATES`` at a time."""
        for r, (keys, of, offset, filters) in enumerate(self.index):
            begin, key = self.keys(r, known, words, at, filters)
            lo = np.searchsorted(keys, key, "left")
            count = np.searchsorted(keys, key, "right") - lo
            begin, lo, count = (x[count > 0] for x in (begin, lo, count))
            cuts = np.flatnonzero(np.diff(np.cumsum(count) // CANDIDATES)) + 1
            for place, first, n in zip(np.split(begin, cuts), np.split(lo, cuts), np.split(count, cuts)):
                if len(n):
                    x = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
                    yield np.repeat(place, n), of[x], offset[x]


def allowed(n: int, percent: int) -> int:
    """Edits that leave a similarity of ``percent``."""
    return n * (100 - percent) // 100


def best_match(item: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance of the item to a part of the text, and that part's last position (leftmost)."""
    masks: dict[int, int] = {}
    for k, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << k
    n, full = len(item), (1 << len(item)) - 1
    plus, minus, distance, top = full, 0, n, 1 << (n - 1)
    best, end = n, -1
    for at, w in enumerate(text):
        eq = masks.get(w, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | ~(xh | plus) & full, plus & xh
        distance += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        plus, minus = mh | ~(xv | ph) & full, ph & xv
        if distance < best:
            best, end = distance, at
    return best, end


def _laid(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sequences one behind the other, apart enough that no walk leads from one into the next: all words, and the place
    of each word of a sequence, with the number of its sequence and where it stands in it."""
    gap = WALKS[0][0]
    lengths = np.array([len(w) for w in sequences], np.int64)
    starts = np.cumsum([0, *(lengths + gap)])
    out = np.zeros(starts[-1] + gap, np.uint64)
    of = np.repeat(np.arange(len(sequences)), lengths)
    offset = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = starts[of] + offset
    out[at] = np.concatenate(sequences) if len(sequences) else np.empty(0, np.uint64)
    return out, at, of, offset


def _bits(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(32)).astype(np.uint32)


PATTERNS = ("mixed", "replaced", "spread")


def edited(words: np.ndarray, edits: int, pattern: str, rng: np.random.Generator) -> np.ndarray:
    """A copy with so many words taken out, put in or replaced (mixed), or replaced by foreign ones, at random places
    or at even distances."""
    copy = words.tolist()
    foreign = rng.integers(1, 1 << 62, edits).tolist()
    places = [int((e + shift) * len(copy) / edits) for e, shift in enumerate([rng.random()] * edits)] if pattern == "spread" else sorted(rng.choice(len(copy), edits, replace=False).tolist())
    kinds = rng.integers(0, 3, edits).tolist() if pattern == "mixed" else [1] * edits
    for at, w, kind in zip(reversed(places), foreign, kinds):
        copy[at : at + 1] = [[], [w], [copy[at], w]][kind]
    return np.array(copy, np.uint64)


class Searcher:
    def __init__(self, items: list[tuple[int, str]], percent: int, least_words: int, recall: float = 0.99) -> None:
        if not 1 <= percent <= 100 or not 0 < recall < 1:
            raise ValueError("percent is 1 to 100, recall is between 0 and 1")
        hashes, first = hash_words([normal(t) for _, t in items])
        hashes |= np.uint64(1)  # 0 is a word of no item
        kept = [(i, hashes[a:b]) for (i, _), a, b in zip(items, first, first[1:]) if b > a]
        self.vocabulary = np.unique(np.concatenate([w for _, w in kept])) if kept else np.empty(0, np.uint64)
        self.items = [(i, w.tolist(), set(w.tolist()), allowed(len(w), percent) if len(w) >= least_words else 0) for i, w in kept]
        self.tolerance = np.array([max(1, edits) for *_, edits in self.items], np.int64)
        self.lengths = np.array([len(w) for _, w in kept], np.int64)
        self.edits = np.array([edits for *_, edits in self.items], np.int64)
        # (item, word) of all items, as bits
        size = 1 << max(10, (16 * max(1, int(self.lengths.sum()))).bit_length())
        self.shift = np.uint64(64 - (size - 1).bit_length())
        self.pairs = np.zeros(size, bool)
        for k, (_, w) in enumerate(kept):
            self.pairs[mix(w ^ mix(np.uint64([k + 1]))) >> self.shift] = True
        #: by class (edits, words where none are allowed): steps and repetitions
        self.classes: dict[tuple[int, int], tuple[int, int]] = {}
        of_class: dict[tuple[int, int], list[int]] = {}
        for k, (_, w) in enumerate(kept):
            of_class.setdefault((e, 0) if (e := self.items[k][3]) else (0, min(len(w), WALKS[0][0])), []).append(k)
        for c, numbers in of_class.items():
            self.classes[c] = self._measured([kept[k][1] for k in numbers], [self.items[k][3] for k in numbers], recall)
        self.walks: list[Walks] = []
        for steps, sampled in WALKS:
            mine = [(k, r) for c, (s, r) in self.classes.items() if s == steps for k in of_class[c]]
            if mine:
                known, at, of, offset = _laid([kept[k][1] for k, _ in mine])
                # an item without edits is its first walk
                some = (offset == 0) | np.array([self.items[k][3] > 0 for k, _ in mine])[of]
                at, of, offset = at[some], of[some], offset[some]
                walks = Walks(steps, sampled)
                walks.build(np.array([k for k, _ in mine])[of], offset, known, _bits(known), at, np.array([r for _, r in mine])[of])
                self.walks.append(walks)

    @staticmethod
    def _measured(items: list[np.ndarray], edits: list[int], recall: float) -> tuple[int, int]:
        """The longest walks, and the fewest repetitions of these, with which the copies of each pattern are found."""
        least = min(map(len, items))
        runs = min(-(-(len(w) - e) // (e + 1)) for w, e in zip(items, edits))
        rng = np.random.default_rng(len(items))
        known, at, of, offset = _laid(items)
        copies = None
        for steps, sampled in WALKS:
            if steps <= runs:
                return steps, 1
            if steps > least:
                continue
            if copies is None:
                source = [k for _ in range(-(-COPIES // len(items))) for k in range(len(items))]
                most = np.array(edits)[source]
                copies = [(len(source), np.array(source), *_laid([edited(items[k], edits[k], pattern, rng) for k in source])) for pattern in PATTERNS]
            walks = Walks(steps, sampled)
            walks.build(of, offset, known, _bits(known), at, np.full(len(at), REPETITIONS))
            needed = 0
            for n, source, words, places, copy, place in copies:
                found = np.full(n, REPETITIONS)
                for r in range(REPETITIONS - 1, -1, -1):
                    keys, mine, start, filters = walks.index[r]
                    begin, key = walks.keys(r, words, _bits(words), places, filters)
                    lo, count = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                    count -= lo
                    x = np.arange(count.sum()) + np.repeat(lo - np.cumsum(count) + count, count)
                    there = np.repeat(np.searchsorted(places, begin), count)
                    # the same item at an alignment that the edits can lead to
                    right = (mine[x] == source[copy[there]]) & (np.abs(place[there] - start[x]) <= most[copy[there]])
                    found[copy[there[right]]] = r
                missed = [int((found >= r).sum()) for r in range(1, REPETITIONS + 1)]
                # two standard deviations of the count on top
                good = [r for r, m in enumerate(missed, 1) if m + 2 * max(m, 1) ** 0.5 <= (1 - recall) * n]
                # and half as many repetitions on top: copies of one item are alike
                needed = max(needed, good[0] * 3 // 2 + 1 if good else REPETITIONS + 1)
            if needed <= REPETITIONS:
                return steps, needed
        raise AssertionError("a walk of one step sees one word")

    def candidates(self, known: np.ndarray, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(number of the text, number of the item, first and last word to look at), each once, whose words can be the
        item's; neighbouring candidates look at nearly the same words: their places are rounded to as many words as
        there may be edits, and the region covers them all."""
        gap = np.zeros(WALKS[0][0], np.uint64)
        known, words, at = np.append(known, gap), np.append(_bits(words), _bits(gap)), np.flatnonzero(known)
        for walks in self.walks:
            for begin, of, offset in walks.hits(known, words, at):
                doc = np.searchsorted(first, begin, "right") - 1
                step, n, edits = self.tolerance[of], self.lengths[of], self.edits[of]
                place = (begin - offset) // step
                x = np.unique(np.stack([doc, of, place]), axis=1, return_index=True)[1]
                doc, of, place, step, n, edits = (y[x] for y in (doc, of, place, step, n, edits))
                lo, hi = np.maximum(first[doc], place * step - 2 * edits), np.minimum(first[doc + 1], (place + 1) * step + n + 2 * edits)
                enough = self.held(known, of, lo, hi) >= n - edits
                yield from zip(*(y[enough].tolist() for y in (doc, of, lo, hi)))

    def held(self, known: np.ndarray, of: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """How many of the words of each region are the item's, as far as a few bits tell: never fewer than there are."""
        out = np.empty(len(of), np.int64)
        most = int((hi - lo).max(initial=1))
        rows = max(1, CANDIDATES // most)
        for k in range(0, len(of), rows):
            part = slice(k, k + rows)
            at = lo[part, None] + np.arange(most)
            inside = at < hi[part, None]
            w = known[np.where(inside, at, lo[part, None])]
            pair = mix(w ^ mix(of[part, None].astype(np.uint64) + np.uint64(1)))
            out[part] = (inside & (w != 0) & self.pairs[pair >> self.shift]).sum(1)
        return out

    def search(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
        """(number of the text, item id, edits, item's words, last word) of each text and item that match."""
        words, first = hash_words(texts)
        words |= np.uint64(1)
        at = np.searchsorted(self.vocabulary, words)
        known = words.copy()
        known[self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] != words] = 0  # words of no item
        best: dict[tuple[int, int], tuple[int, int]] = {}
        tried: set[tuple[int, int, int, int]] = set()
        for doc, k, lo, hi in self.candidates(known, words, first):
            _, item, among, edits = self.items[k]
            if (doc, k, lo, hi) in tried:
                continue
            tried.add((doc, k, lo, hi))
            text = known[lo:hi].tolist()
            if sum(w in among for w in text) < len(item) - edits:
                continue
            distance, end = best_match(item, text)
            if distance <= edits:
                best[doc, k] = min(best.get((doc, k), (distance + 1, 0)), (distance, int(lo + end - first[doc])))
        for (doc, k), (distance, end) in sorted(best.items()):
            yield doc, self.items[k][0], distance, len(self.items[k][1]), end


_SCHEMA = "doc_id long, item_id long, edits long, item_words long, last_word long"


def _search(shared: Broadcast[Searcher]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = shared.value
        for batch in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = normal(t.as_py())
                if texts and size + len(text) > CHUNK:
                    yield from _found(searcher, ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(text)
                size += len(text)
            yield from _found(searcher, ids, texts)

    return run


def _found(searcher: Searcher, ids: list[int | None], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
    rows = [(ids[d], *rest) for d, *rest in searcher.search(texts)] if searcher.items else []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "item_id", "edits", "item_words", "last_word"])


def contamination(docs: DataFrame, benchmark: DataFrame, percent: int = 80, least_words: int = 8, id_col: str = "doc_id", text_col: str = "text", block_items: int = BLOCK_ITEMS, recall: float = 0.99) -> DataFrame:
    """(doc_id, item_id, edits, item_words, last_word) of each document and benchmark item of which the document
    has a passage with at most 100 - ``percent`` percent of the item's words edited; the best place (the first of
    equals).  Unchanged passages are always found, edited ones with the chance ``recall`` at least, which holds for each
    class of items and each pattern of edits.

    Very long texts are searched whole.  Of items of fewer than ``least_words`` words only unchanged copies are matches.  Null and empty texts and those
    without a word hold nothing, on either side.  A repeated document row gives its matches again; equal items match alike;
    items with one id and different texts have a row each, and a repeated item row counts once.
    Null doc_ids pass through; items with a null id are left out.  How many items
    aren't searched for is logged as a warning.  Without documents or items the result is
    empty; other columns are not looked at.  The items are the query set: they go to the tasks in blocks of
    about ``block_items``, each of which is a pass over the documents.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    total = benchmark.select("item_id", "text").distinct().count()
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, ceil(n / block_items), ceil(size / BLOCK_BYTES))
    out, searched = None, 0
    for k in range(blocks):
        block = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).distinct().orderBy("item_id", "text").collect()]
        searcher = Searcher(block, percent, least_words, recall)
        searched += len(searcher.items)
        searcher = docs.sparkSession.sparkContext.broadcast(searcher)
        part = docs.mapInArrow(_search(searcher), _SCHEMA)
        out = part if out is None else out.union(part)
    if searched < total:
        _LOG.warning("%d of %d items aren't searched for: they have no id, no text or no word", total - searched, total)
    return out
