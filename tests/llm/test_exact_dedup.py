import hashlib
import random

import pytest
from awkward import ROWS, documents, empty

from shapeloom.llm import exact_dedup as E


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(rows):
    groups, out = {}, []
    for i, t, *_ in rows:
        groups.setdefault(low(t), []).append(i)
    taken = set()
    for i, t, *_ in rows:
        g = groups[low(t)]
        keeper = max((x for x in g if x is not None), default=None)
        kept = i == keeper and low(t) not in taken
        if kept:
            taken.add(low(t))
        out.append((i, keeper, len(g), kept, hashlib.sha256(low(t).encode()).hexdigest()))
    return sorted(map(repr, out))


def got(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("table_bytes", [E.TABLE_BYTES, 2000])
def test_awkward(spark, table_bytes):
    assert got(E.exact_dedup(documents(spark).repartition(3), table_bytes=table_bytes)) == brute(ROWS)


def test_empty(spark):
    assert E.exact_dedup(empty(spark)).count() == 0


@pytest.mark.parametrize("table_bytes", [E.TABLE_BYTES, 4000])
def test_hot_group(spark, table_bytes):
    random.seed(1)
    rows = [(k, "Hot text" if k % 3 == 0 else f"text {random.randrange(60)} " * random.randrange(1, 4), "en") for k in range(900)]
    assert got(E.exact_dedup(documents(spark, rows).repartition(7), table_bytes=table_bytes)) == brute(rows)


def test_grace_recursion():
    """Buckets that don't fit are split again and again; colliding hashes are told apart by their content."""
    records = [(h, k, 1, k, b"%d" % (k % 40)) for k in range(200) for h in [(k % 40) % 3 << 62 | (k % 40) % 2]]
    seen = {}
    for table, members in E.grace(iter(records), table_bytes=300):
        for tag, keeper, rows, k in members.tolist():
            seen[tag] = (table.contents[k], table.keepers[k], table.rows[k])
    assert seen == {k: (b"%d" % (k % 40), 160 + k % 40, 5) for k in range(200)}


def test_tables_grow():
    t = E.OpenTable()
    for k in range(5000):
        t.add(k * 7919, b"%d" % k, k, 1)
    assert t.add(7919, b"1", 9, 2) == 1 and t.rows[1] == 3 and t.keepers[1] == 9 and len(t.contents) == 5000
