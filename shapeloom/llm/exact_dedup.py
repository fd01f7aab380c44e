"""Exact dedup by Grace hash partitioning.

Two rounds, so that a text with a third of all rows never meets in one task:

1. inside each input partition equal texts meet in a Grace hash table, which leaves one *local keeper* per
   distinct text (its largest doc_id), its row count, and for every row the name of its local keeper;
2. only the local keepers are shuffled, by a hash of the text, and meet in a second Grace hash table.

The rows then take their final keeper by a join on the local keeper, of which no partition has more rows
than it had to begin with, so that join cannot be skewed by a hot text.

A Grace table holds records up to ``table_bytes``; beyond it the records go to ``FANOUT`` spill files by
the next bits of their hash, and each file is treated the same way, until a file fits.  A file that holds
one distinct text only always fits, since equal records merge as they are read.  The table itself is an
open-addressing array of record numbers with linear probing, which compares complete contents.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import struct
import tempfile
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

FANOUT = 16
TABLE_BYTES = 32 << 20
#: Stands for a null id inside.
NO_ID = -(1 << 63)
_HEAD = struct.Struct("<QqqqQ")


class OpenTable:
    """Records by complete content: hash, content, largest id, rows."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.keepers: list[int] = []
        self.rows: list[int] = []
        self.bytes = 0

    def _grow(self) -> None:
        size = 2 * len(self.slots)
        slots = [-1] * size
        for k, h in enumerate(self.hashes):
            at = h & (size - 1)
            while slots[at] >= 0:
                at = (at + 1) & (size - 1)
            slots[at] = k
        self.slots = slots

    def add(self, h: int, content: bytes, keeper: int, rows: int) -> int:
        """The record's number."""
        slots, mask = self.slots, len(self.slots) - 1
        at = h & mask
        while (k := slots[at]) >= 0:
            if self.hashes[k] == h and self.contents[k] == content:
                self.rows[k] += rows
                self.keepers[k] = max(self.keepers[k], keeper)
                return k
            at = (at + 1) & mask
        k = len(self.contents)
        slots[at] = k
        self.hashes.append(h)
        self.contents.append(content)
        self.keepers.append(keeper)
        self.rows.append(rows)
        self.bytes += len(content) + 120
        if 2 * len(self.contents) > mask:
            self._grow()
        return k


def _spill_root() -> str:
    """Where Spark itself spills, if the worker knows it."""
    for folder in os.environ.get("SPARK_LOCAL_DIRS", "").split(","):
        if folder and os.access(folder, os.W_OK):
            return folder
    return tempfile.gettempdir()


def grace(records: Iterable[tuple[int, int, int, int, bytes]], table_bytes: int = TABLE_BYTES, level: int = 0) -> Iterator[tuple[OpenTable, np.ndarray]]:
    """Records (hash, keeper, rows, tag, content) in; for one bucket after the other, out come its table and
    an array with a line (tag, keeper, rows, record number) for each of its members.  Equal contents are in
    the same bucket."""
    records = iter(records)
    table, members = OpenTable(), array("q")
    for h, keeper, rows, tag, content in records:
        members.extend((tag, keeper, rows, table.add(h, content, keeper, rows)))
        # equal hashes can't be parted: neither one content, nor what is left when the hash has no bits more
        if table.bytes > table_bytes and len(table.contents) > 1 and level < 16:
            break
    else:
        if members:
            yield table, np.frombuffer(members, np.int64).reshape(-1, 4)
        return
    folder = tempfile.mkdtemp(prefix="grace-", dir=_spill_root())
    try:
        files = [open(os.path.join(folder, str(k)), "wb") for k in range(FANOUT)]
        try:
            for tag, keeper, rows, k in np.frombuffer(members, np.int64).reshape(-1, 4).tolist():
                _put(files, level, table.hashes[k], keeper, rows, tag, table.contents[k])
            del table, members
            for record in records:
                _put(files, level, *record)
        finally:
            for f in files:
                f.close()
        for f in files:
            yield from grace(_spilled(f.name), table_bytes, level + 1)
            os.remove(f.name)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def _put(files: list, level: int, h: int, keeper: int, rows: int, tag: int, content: bytes) -> None:
    f = files[(h >> (60 - 4 * level)) & 15]
    f.write(_HEAD.pack(h, keeper, rows, tag, len(content)))
    f.write(content)


def _spilled(path: str) -> Iterator[tuple[int, int, int, int, bytes]]:
    with open(path, "rb") as f:
        while head := f.read(_HEAD.size):
            *record, length = _HEAD.unpack(head)
            yield (*record, f.read(length))


_LOCAL = "doc_id long, local long, sha binary, local_kept boolean, rows long, text binary"
_FINAL = "local long, keep_id long, group_size long, final_kept boolean"
#: Records that one local table may see, so that its list of members is bounded too.
RUN = 1 << 20


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, int, bytes]]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        for i, text in zip(batch.column(0).to_pylist(), texts):
            text = (text.as_py() or b"").lower()  # of bytes: A-Z only
            yield xxhash.xxh3_64_intdigest(text), i, 1, i, text


def _local(table_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, made, first = _texts(batches), 0, TaskContext.get().partitionId() << 33
        while head := list(islice(records, 1)):
            for table, members in grace(chain(head, islice(records, RUN - 1)), table_bytes):
                shas = [hashlib.sha256(x).digest() for x in table.contents]
                ids, k = members[:, 1], members[:, 3]
                # the first member that has its record's keeper as its id carries the text on
                carrier = np.zeros(len(ids), bool)
                at = np.flatnonzero(ids == np.array(table.keepers, np.int64)[k])
                carrier[at[np.unique(k[at], return_index=True)[1]]] = True
                for lo, hi in _cuts([len(table.contents[r]) if c else 0 for r, c in zip(k.tolist(), carrier.tolist())]):
                    part = k[lo:hi].tolist()
                    yield pa.RecordBatch.from_arrays([
                        pa.array(ids[lo:hi]), pa.array(k[lo:hi] + (first + made)), pa.array([shas[r] for r in part], pa.binary()), pa.array(carrier[lo:hi]),
                        pa.array([table.rows[r] for r in part], pa.int64()), pa.array([table.contents[r] if c else None for r, c in zip(part, carrier[lo:hi].tolist())], pa.binary()),
                    ], ["doc_id", "local", "sha", "local_kept", "rows", "text"])
                made += len(table.contents)

    return run


def _cuts(sizes: list[int], most: int = 4 << 20, rows: int = 20_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows that are small enough for one Arrow batch."""
    lo = total = 0
    for hi, size in enumerate(sizes):
        if hi > lo and (total + size > most or hi - lo >= rows):
            yield lo, hi
            lo, total = hi, 0
        total += size
    if lo < len(sizes):
        yield lo, len(sizes)


def _final(table_bytes: int):
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, int, bytes]]:
        for batch in batches:
            keys = (batch.column(c).to_pylist() for c in (0, 1, 2))
            for keeper, rows, tag, text in zip(*keys, batch.column(3)):
                yield xxhash.xxh3_64_intdigest(text := text.as_py()), keeper, rows, tag, text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, members in grace(records(batches), table_bytes):
            order = np.argsort(members[:, 0])
            tag, ids, _, k = members[order].T
            keepers = np.array(table.keepers, np.int64)[k]
            kept = np.zeros(len(k), bool)
            at = np.flatnonzero(ids == keepers)
            kept[at[np.unique(k[at], return_index=True)[1]]] = True
            for lo in range(0, len(k), 100_000):
                cut = slice(lo, lo + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(x[cut]) for x in (tag, keepers, np.array(table.rows, np.int64)[k], kept)], ["local", "keep_id", "group_size", "final_kept"])

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty, and an empty text is
    a text like others, as is a very long one: a task holds a table of ``table_bytes``, or one text.  Of equal
    texts the row with the largest id stays, and one row where several have that id; a null id is smaller than
    all others (and the same as the least long integer), so keep_id is null only where no equal text has an id.
    An empty table gives an empty result; further columns of ``docs`` are not looked at.
    """
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).alias("text"))
    local = scratch.table(docs.mapInArrow(_local(table_bytes), _LOCAL), "exact-local")
    carriers = local.where("local_kept").select("doc_id", "rows", "local", "text").repartition(F.xxhash64("text"))
    final = carriers.mapInArrow(_final(table_bytes), _FINAL)
    named = lambda c: F.nullif(c, F.lit(NO_ID)).alias(c)
    return local.select("doc_id", "local", "sha", "local_kept").join(final, "local").select(
        named("doc_id"), named("keep_id"), "group_size", (F.col("local_kept") & F.col("final_kept")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )
