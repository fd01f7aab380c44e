"""Near duplicates: MinHash bands find candidates, sequential Bayesian tests prune them, full sets decide.

1. One pass makes of each text its set of shingle hashes: the size, a digest, a signature and band keys.
   Texts with equal sets are one class and are represented by their smallest id.
2. Each band bucket with several representatives has a *hub*, the smallest.  Every member is tested against
   the smallest of its hubs: one test each, however large the buckets.  Links give components.
3. Members that are not in their hub's component may still be linked with others of the bucket.  They are
   tested against all members, in blocks of bounded size that two at a time meet in a task; only pairs between
   components, each pair in the first bucket it has in common.  First only signatures meet, which tell the
   members that have a partner left in that task; then the texts of these alone meet there, and a task gives back
   links that join components, never pairs.
4. Components of all links, then every document takes its class's component.

A test compares signatures batch by batch.  With m of n values equal and a uniform prior, the posterior
probability of a similarity of at least t is P(Binomial(n + 1, t) <= m); when it falls below ``miss``, the
pair is pruned.  Survivors are decided on their full sets (of 64-bit shingle hashes) in whole numbers.  Bands
are as long as they can be while a pair at the threshold shares no band with a probability of at most
``BAND_MISS``.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .components import connected_components
from .textops import chunks, hash_words, mix, shingles

HASHES = 160
BAND_MISS = 1e-5
BATCH = 32
#: Ids of at most so many bytes (32 each, in a hash table) are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: Most members and most shingles (8 bytes each) of a block.
BLOCK_MEMBERS, BLOCK_SHINGLES = 1024, 1 << 20


def banding(percent: int, hashes: int = HASHES) -> tuple[int, int]:
    """Rows of a band and bands for a threshold in percent."""
    fits = [(r, hashes // r) for r in range(1, hashes + 1) if (1 - (percent / 100) ** r) ** (hashes // r) <= BAND_MISS]
    return fits[-1]


def least_matches(percent: int, hashes: int, miss: float) -> list[tuple[int, int]]:
    """(n, least m that survives) after each batch."""
    t, out = percent / 100, []
    for n in [*range(BATCH, hashes, BATCH), hashes]:
        below, m = 0.0, -1
        while below < miss and m < n:
            m += 1
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def _hashers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed xor and odd factor of each hash."""
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = (x >> np.uint64(32)).astype(np.uint32)
    return x[:n], x[n:] | np.uint32(1)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted set of each text."""
    words, first = hash_words([t.lower() for t in texts])
    return [np.unique(shingles(words[a:b], width)) for a, b in zip(first, first[1:])]


def signatures(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """uint32 [set, hash]; the sets aren't empty."""
    out = np.empty((len(sets), hashes), np.uint32)
    xors, factors = _hashers(hashes)
    lo = 0
    while lo < len(sets):
        hi, total = lo + 1, len(sets[lo])
        while hi < len(sets) and total + len(sets[hi]) <= 1 << 16:
            total += len(sets[hi])
            hi += 1
        x = (np.concatenate(sets[lo:hi]) >> np.uint64(32)).astype(np.uint32)
        at = np.cumsum([0, *(len(s) for s in sets[lo : hi - 1])])
        for k in range(hashes):
            y = x ^ xors[k]
            y *= factors[k]
            out[lo:hi, k] = np.minimum.reduceat(y, at)
        lo = hi
    return out


def band_keys(sig: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """int64 [set, band]; keys of different bands differ."""
    out = np.empty((len(sig), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(sig), b + 1, np.uint64)
        for k in range(b * rows, (b + 1) * rows):
            h = mix(h * np.uint64(0x2545F4914F6CDD1D) + sig[:, k])
        out[:, b] = h
    return out.view(np.int64)


_FEATURES = "doc_id long, n long, digest binary, sig binary, bands array<long>"


def _features(width: int, rows: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            sets = shingle_sets(texts, width)
            full = [s for s in sets if len(s)]
            sig = signatures(full, rows * bands) if full else np.empty((0, rows * bands), np.uint32)
            keys = band_keys(sig, rows, bands)
            at = np.cumsum([len(s) > 0 for s in sets]) - 1
            low = sig.astype(np.uint16)
            some = lambda f: [f(k) if len(s) else None for s, k in zip(sets, at.tolist())]  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array(some(lambda k: low[k].tobytes()), pa.binary()), pa.array(some(lambda k: keys[k]), pa.list_(pa.int64())),
            ], ["doc_id", "n", "digest", "sig", "bands"])

    return run


class Tester:
    """Tests of pairs at one threshold."""

    def __init__(self, width: int, percent: int, hashes: int, miss: float) -> None:
        self.width, self.percent, self.steps = width, percent, least_matches(percent, hashes, miss)

    def sets(self, rows: list[dict]) -> list[np.ndarray]:
        """Full sets, made from the texts when they are first needed."""
        new = [r for r in rows if "full" not in r]
        for lo in range(0, len(new), 64):
            for r, full in zip(new[lo : lo + 64], shingle_sets([r["text"].encode() for r in new[lo : lo + 64]], self.width)):
                r["full"] = full
        return [r["full"] for r in rows]

    def surviving(self, sig: np.ndarray, sigs: np.ndarray) -> np.ndarray:
        """Rows of ``sigs`` that are not pruned."""
        left, same, lo = np.arange(len(sigs)), np.zeros(len(sigs), np.int64), 0
        for hi, least in self.steps:
            same += (sigs[left, lo:hi] == sig[lo:hi]).sum(1)
            keep = same >= least
            left, same, lo = left[keep], same[keep], hi
            if not len(left):
                break
        return left

    def linked(self, one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
        """Which of the sets reach the threshold."""
        sizes = np.array([len(o) for o in others])
        flat = np.concatenate(others)
        at = np.searchsorted(one, flat)
        hit = one[np.minimum(at, len(one) - 1)] == flat
        both = np.add.reduceat(hit.astype(np.int64), np.cumsum([0, *sizes[:-1]]))
        return 100 * both >= self.percent * (len(one) + sizes - both)


_LINKS = "u long, v long"


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            yield from batch.slice(lo, 256).to_pylist()


def _star(test: tuple):
    """Rows come by (hub, block), the hub before the members: only the hub is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tester, hub, hub_sig, found = Tester(*test), None, None, []
        for r in _rows(batches):
            sig = np.frombuffer(r["sig"], np.uint16)
            if not r["member"]:
                hub, hub_sig = r, sig
            elif hub and r["hub"] == hub["hub"] and len(tester.surviving(hub_sig, sig[None])) and tester.linked(tester.sets([hub])[0], tester.sets([r]))[0]:
                found.append((hub["hub"], r["rep"]))
                if len(found) >= 10_000:
                    yield _links(found)
                    found = []
        if found:
            yield _links(found)

    return run


class Meeting:
    """Members of two blocks of a bucket: ``side`` 0 meets ``side`` 1."""

    def __init__(self, tester: Tester, bands: int, hub: int, alone: bool, rows: list[dict]) -> None:
        self.tester, self.bands, self.hub, self.alone = tester, bands, hub, alone
        seen = {(r["rep"], r["side"]): r for r in rows}
        self.left = [r for r in seen.values() if r["side"] == 0]
        self.right = [r for r in seen.values() if r["side"] == 1]
        self.root: dict[int, int] = {}
        if self.right:
            self.ids = np.array([r["rep"] for r in self.right])
            self.sigs = np.stack([np.frombuffer(r["sig"], np.uint16) for r in self.right])
            self.hubs = np.stack([self._hubs(r, -1) for r in self.right])
            self.components = np.array([r["component"] for r in self.right])

    def _hubs(self, r: dict, none: int) -> np.ndarray:
        out = np.full(self.bands, none, np.int64)
        for x in r["hubs"]:
            out[x["band"]] = x["hub"]
        return out

    def find(self, c: int) -> int:
        while (up := self.root.get(c, c)) != c:
            c = up
        return c

    def near(self, r: dict) -> np.ndarray:
        """Numbers of the right members that are another component's, have this bucket as the first in common with
        ``r`` and aren't pruned by their signatures."""
        same = self.hubs == self._hubs(r, -2)
        first = self.hubs[np.arange(len(self.right)), same.argmax(1)]
        there = same.any(1) & (first == self.hub) & (self.components != self.find(r["component"])) & (self.ids > r["rep"] if self.alone else self.ids != r["rep"])
        k = np.flatnonzero(there)
        return k[self.tester.surviving(np.frombuffer(r["sig"], np.uint16), self.sigs[k])]

    def marked(self) -> list[dict]:
        """Members with a partner."""
        hit, out = np.zeros(len(self.right), bool), []
        for r in self.left if self.right else ():
            near = self.near(r)
            hit[near] = True
            if len(near):
                out.append(r)
        return out + [self.right[k] for k in np.flatnonzero(hit).tolist()]

    def links(self) -> list[tuple[int, int]]:
        """Links, by full sets, that join components."""
        found = []
        for r in self.left if self.right else ():
            near = self.near(r)
            if not len(near):
                continue
            for k in near[self.tester.linked(self.tester.sets([r])[0], self.tester.sets([self.right[k] for k in near]))].tolist():
                a, b = self.find(r["component"]), self.find(self.right[k]["component"])
                if a != b:
                    self.root[max(a, b)] = min(a, b)
                    self.components[self.components == max(a, b)] = min(a, b)
                    found.append((r["rep"], self.right[k]["rep"]))
        return found


def _meet(test: tuple, bands: int, handle):
    """Rows come by (hub, left, right, kind); those of one task are held: two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tester, key, rows = Tester(*test), None, []
        meeting = lambda: Meeting(tester, bands, key[0], key[1] == key[2] and not key[3], rows)
        for r in _rows(batches):
            now = (r["hub"], r["i"], r["j"], r["main"])
            if now != key:
                if rows:
                    yield from handle(meeting())
                key, rows = now, []
            rows.append(r)
        if rows:
            yield from handle(meeting())

    return run


_MARKS = "rep long, hub long, component long, i int, j int, main boolean, side int"
_MARK = pa.schema([("rep", pa.int64()), ("hub", pa.int64()), ("component", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("main", pa.bool_()), ("side", pa.int32())])


def _mark(meeting: Meeting) -> Iterator[pa.RecordBatch]:
    if rows := meeting.marked():
        yield pa.RecordBatch.from_pylist([{n: r[n] for n in _MARK.names} for r in rows], _MARK)


def _link(meeting: Meeting) -> Iterator[pa.RecordBatch]:
    if found := meeting.links():
        yield _links(found)


def near_duplicates(docs: DataFrame, width: int, percent: int, miss: float = 1e-6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    A-Z are lower-cased, words stand between ASCII white space, a document's set are its distinct runs of
    ``width`` words; with fewer words, the whole sequence as one.  Documents are linked when 100 x
    intersection >= ``percent`` x union; component_id is the smallest id that links reach, kept tells whether
    that is the document's own.  Null and empty texts have no shingles and no links; of a very long text the whole set counts.  Rows with the same id
    are the same document to links and are all kept or all dropped; a row with a null id has no component and
    is kept.  An empty table gives an empty result; other columns are not looked at.
    """
    rows, bands = banding(percent)
    test = (width, percent, rows * bands, miss)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    features = scratch.table(docs.mapInArrow(_features(width, rows, bands), _FEATURES), "near-features")
    named = features.where("doc_id is not null and n > 0")
    classes = scratch.table(named.groupBy("digest").agg(F.min("doc_id").alias("rep")), "near-classes")
    reps = named.join(classes, (named.digest == classes.digest) & (named.doc_id == classes.rep), "left_semi")

    members = reps.select(F.col("doc_id").alias("rep"), F.posexplode("bands").alias("band", "key"))
    hubs = members.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub < last").drop("last")
    shared = members.join(scratch.apart(hubs), "key").groupBy("rep").agg(F.collect_list(F.struct("band", "hub")).alias("hubs"))
    shared = scratch.table(shared, "near-shared")
    ids = shared.select("rep")
    ids = F.broadcast(ids) if 32 * ids.count() <= BROADCAST_BYTES else ids
    few = lambda df: df.join(ids, df.doc_id == ids.rep, "left_semi").withColumnRenamed("doc_id", "rep")
    near = shared.join(few(named.select("doc_id", "n", "sig")), "rep").join(few(docs), "rep")
    near = scratch.table(near, "near-texts")

    # every member against the smallest of its hubs
    load = lambda kind: F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count("*") / BLOCK_MEMBERS)).cast("int").alias(kind)
    block = lambda of: F.pmod(F.xxhash64("rep", "hub"), F.greatest(F.col(of), F.lit(1))).cast("int")
    pairs = near.select("rep", "n", F.array_min("hubs.hub").alias("hub")).where("hub < rep")
    loads = pairs.groupBy("hub").agg(load("blocks"))
    to_hub = pairs.join(scratch.apart(loads), "hub").select("rep", "hub", block("blocks").alias("block"), F.lit(True).alias("member"))
    of_hub = loads.select(F.col("hub").alias("rep"), "hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("member"))
    work = to_hub.union(of_hub).join(near.select("rep", "sig", "text"), "rep")
    work = work.repartition("hub", "block").sortWithinPartitions("hub", "block", "member")
    stars = scratch.table(work.mapInArrow(_star(test), _LINKS), "near-stars")

    # the others against all members
    first = connected_components(stars)
    comps = near.select("rep", "n", F.explode(F.array_distinct("hubs.hub")).alias("hub")).join(first.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    of_hub = comps.where("rep = hub").select("hub", F.col("component").alias("hub_component")).distinct()
    placed = comps.join(scratch.apart(of_hub), "hub").withColumn("main", F.col("component") == F.col("hub_component"))
    placed = scratch.table(placed, "near-placed")
    loads = placed.groupBy("hub", "main").agg(load("blocks")).groupBy("hub").agg(F.max(F.when(~F.col("main"), F.col("blocks"))).alias("others"), F.max(F.when(F.col("main"), F.col("blocks"))).alias("mains")).where("others is not null")
    placed = placed.join(scratch.apart(loads), "hub").withColumn("own", F.when(F.col("main"), block("mains")).otherwise(block("others")))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    base = ("rep", "hub", "component")
    # others of block i meet main members of block j; others of blocks i <= j meet each other
    tasks = [
        placed.where("main").select(*base, F.explode(upto("others")).alias("i"), F.col("own").alias("j"), F.lit(True).alias("main"), F.lit(1).alias("side")),
        placed.where("not main").select(*base, F.col("own").alias("i"), F.explode(upto("mains")).alias("j"), F.lit(True).alias("main"), F.lit(0).alias("side")),
        placed.where("not main").select(*base, F.col("own").alias("i"), F.explode(F.sequence(F.col("own"), F.col("others") - 1)).alias("j"), F.lit(False).alias("main"), F.lit(0).alias("side")),
        placed.where("not main").select(*base, F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"), F.col("own").alias("j"), F.lit(False).alias("main"), F.lit(1).alias("side")),
    ]
    together = lambda df: df.repartition("hub", "i", "j", "main").sortWithinPartitions("hub", "i", "j", "main", "rep")
    work = tasks[0].union(tasks[1]).union(tasks[2]).union(tasks[3]).join(near.select("rep", "sig", "hubs"), "rep")
    marks = scratch.table(together(work).mapInArrow(_meet(test, bands, _mark), _MARKS), "near-marks")
    rest = together(marks.join(near.select("rep", "sig", "text", "hubs"), "rep")).mapInArrow(_meet(test, bands, _link), _LINKS)

    comp = connected_components(first.select("id", "component").toDF("u", "v").union(rest)).select(F.col("id").alias("rep"), "component")
    of_class = classes.join(comp, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = features.select("doc_id", "n", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
