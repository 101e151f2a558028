import random

import numpy as np
import pytest
import xxhash

from tidecast.llm import simhash as X

SCHEMA = "doc_id long, text string, print string, component_id int"


def brute_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [brute_print(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and group[i] != group[j]:
                group = [group[i] if g == group[j] else g for g in group]
    low = {}
    for (i, _), g in zip(rows, group, strict=True):
        low[g] = min((x for x in (low.get(g), i) if x is not None), default=None)
    return sorted(((i, f"{p:016x}", low[g]) for (i, _), p, g in zip(rows, prints, group, strict=True)), key=str)


def answer(spark, rows, **more):
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(4)
    got = X.near_copies(frame, **more)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    return sorted(map(tuple, got.collect()), key=str)


def random_rows():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)] + ["Ünï", "ÉA", "Ab"]
    rows = []
    for i in range(120):
        text = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 30, 200]))]
        rows.append((i * 3 % 127, rng.choice([" ", "\t\n", "  "]).join(text)))
        for _ in range(rng.choice([0, 0, 1, 4])):  # a word changed: often a bit or two
            near = list(text)
            near[rng.randrange(len(near))] = rng.choice(words)
            rows.append((200 + len(rows), " ".join(near)))
    return rows


def test_matches_brute_force(spark):
    rows = random_rows()
    want = brute(rows)
    assert len({r[2] for r in want}) < len({r[1] for r in want})  # some are linked
    assert answer(spark, rows, leaf=8, first=4) == want


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(X, "STRETCH", 64)
    rows = [(5, None), (4, ""), (6, " \n "), (9, "one"), (9, "ONE"), (None, "one two"), (None, "only null"), (8, "one two"), (3, "a b c"),
            (2, "word " * 3000), (1, "word " * 3001), (7, " ".join(f"v{i}" for i in range(5000))), (7, "a b c")]
    assert answer(spark, rows) == brute(rows)
    assert answer(spark, []) == []


@pytest.mark.parametrize("leaf,first", [(4, 4), (50, 16), (8192, 16)])
def test_links_of_dense_fingerprints(spark, leaf, first):
    rng = np.random.default_rng(leaf)
    base = rng.integers(0, 2 ** 64, 12, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (200, 3), dtype=np.uint64)
    prints = np.unique(np.concatenate([base[rng.integers(0, 12, 200)] ^ np.bitwise_xor.reduce(flips, axis=1), base, np.arange(40, dtype=np.uint64)]))
    frame = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "print long")
    got = [frozenset(r) for r in X.links(frame, leaf=leaf, first=first).collect()]
    near = np.bitwise_count(prints[:, None] ^ prints) <= 2
    want = {frozenset((int(prints[i].view(np.int64)), int(prints[j].view(np.int64)))) for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True)}
    assert len(got) == len(set(got)) and set(got) == want
