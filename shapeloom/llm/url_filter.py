"""URL rules looked up in a sorted digest array.

The rules' keys (host + path) are hashed with 64-bit xxhash and written to a file: the sorted digests, then the
offsets of the keys, then the keys.  The file lies in the shared folder, and ``SparkContext.addFile`` brings it to every
executor once, where all workers map the same pages.  A batch of urls is looked up at a time: each url gives the keys
that a rule for it could have (host suffixes at dots x path prefixes as long as some rule's path), one vectorised
binary search finds their digests, and the stored key decides where digests agree.

Rules of a table are any number: ``SHARD_RULES`` of them at a time come to the driver and make a file each; a key's
CRC tells which file it is in.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

#: Rules of a file, on the average.
SHARD_RULES = 500_000
_PARTS = re.compile("([^/?#]*)([^?#]*)")
_LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host, path = _PARTS.match(rest).groups()
    return host.translate(_LOWER), path


class DigestArray:
    """The file, mapped."""

    def __init__(self, path: str) -> None:
        n, widths = np.fromfile(path, np.uint64, 2).tolist()
        at = 16
        self.path_lengths = np.fromfile(path, np.uint64, widths, offset=at).tolist()
        at += 8 * widths
        if n:
            self.digests = np.memmap(path, np.uint64, "r", at, (n,))
            self.offsets = np.memmap(path, np.uint64, "r", at + 8 * n, (n + 1,))
            self.keys = np.memmap(path, np.uint8, "r", at + 16 * n + 8, (max(1, int(self.offsets[-1])),))
        self.n = n

    @staticmethod
    def pack(rules: Iterable[tuple[str, str, str]]) -> bytes:
        """rules: (action, host, path); a key given twice keeps its last action."""
        by_key = {f"{host}{p}": (action, len(p)) for action, host, p in rules}
        stored = sorted((xxhash.xxh64_intdigest(k.encode()), f"{action[0]}{k}".encode()) for k, (action, _) in by_key.items())
        widths = sorted({w for _, w in by_key.values()})
        digests = np.array([len(stored), len(widths), *widths, *(d for d, _ in stored)], np.uint64)
        offsets = np.cumsum([0, *(len(k) for _, k in stored)]).astype(np.uint64)
        return digests.tobytes() + offsets.tobytes() + b"".join(k for _, k in stored)

    def find(self, keys: list[bytes], digest=xxhash.xxh64_intdigest) -> list[str | None]:
        """The action of each key that is stored."""
        out: list[str | None] = [None] * len(keys)
        if not self.n or not keys:
            return out
        wanted = np.fromiter(map(digest, keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, wanted)
        for k in np.flatnonzero(self.digests[np.minimum(at, self.n - 1)] == wanted).tolist():
            i = int(at[k])
            while i < self.n and self.digests[i] == wanted[k]:
                stored = self.keys[int(self.offsets[i]) : int(self.offsets[i + 1])].tobytes()
                if stored[1:] == keys[k]:
                    out[k] = "allow" if stored[:1] == b"a" else "block"
                    break
                i += 1
        return out


class Shards:
    """Digest arrays, one for each remainder of the keys' CRC."""

    def __init__(self, paths: list[str]) -> None:
        self.arrays = [DigestArray(p) for p in paths]
        self.path_lengths = sorted({w for a in self.arrays for w in a.path_lengths})

    def find(self, keys: list[bytes]) -> list[str | None]:
        if len(self.arrays) == 1:
            return self.arrays[0].find(keys)
        shard = np.fromiter((zlib.crc32(k) % len(self.arrays) for k in keys), np.int64, len(keys))
        out: list[str | None] = [None] * len(keys)
        for k in np.unique(shard).tolist():
            mine = np.flatnonzero(shard == k).tolist()
            for i, action in zip(mine, self.arrays[k].find([keys[i] for i in mine])):
                out[i] = action
        return out


def _judge(names: list[str], default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Shards([SparkFiles.get(name) for name in names])
        for batch in batches:
            parts = [split_url(url) for url in batch.column(1).to_pylist()]
            keys, owner, rank = [], [], []
            for row, (host, path) in enumerate(parts):
                at = 0
                while True:
                    for w in rules.path_lengths:
                        if w <= len(path):
                            keys.append((host[at:] + path[:w]).encode())
                            owner.append(row)
                            rank.append((len(host) - at + w, len(host) - at))
                    at = host.find(".", at) + 1
                    if not at:
                        break
            best: list[tuple] = [((-1, -1), None, default)] * len(parts)
            for k, action in enumerate(rules.find(keys)):
                if action and rank[k] > best[owner[k]][0]:
                    best[owner[k]] = (rank[k], keys[k].decode(), action)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array([b[1] for b in best], pa.string()), pa.array([b[2] for b in best], pa.string())],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    return run


def url_filter(pages: DataFrame, rules: DataFrame | list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow", shard_rules: int = SHARD_RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of each url.

    ``rules`` has (action, host, path).  A rule fits its host and all subdomains if the url's path starts
    with the rule's; the longest (host and path together, then host) wins; without one, ``default`` holds.  Rules of a table
    with one host and path must have one action; a rule that lacks one of the three is none.
    A null url, or one without ``://``, has an empty host and path; a very long one is judged whole.  Null ids pass
    through, repeated rows are judged alike, an empty table gives an empty result, other columns are not looked at.
    """
    spark: SparkSession = pages.sparkSession
    if isinstance(rules, DataFrame):
        rules = rules.select("action", "host", "path").dropna()
        shards = max(1, -(-rules.count() // shard_rules))
        crc = F.crc32(F.concat("host", "path").cast("binary")) % shards
        parts = (map(tuple, rules.where(crc == k).collect()) for k in range(shards))
    else:
        parts = iter([rules])
    names = []
    for part in parts:
        path = scratch.new_path(spark, "url-rules")
        system, inner = scratch.file_system(path)
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        with system.open_output_stream(inner) as f:
            f.write(DigestArray.pack(part))
        spark.sparkContext.addFile(path)
        names.append(path.rpartition("/")[2])
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
    return urls.mapInArrow(_judge(names, default), "page_id long, host string, path string, rule string, verdict string")
