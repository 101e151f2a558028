import hashlib
import random
import zlib

import pytest

from tidecast.llm import prefix_trie as X

SCHEMA = "conv_id long, turn long, role string, text string, depth int, path string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", sha(text or ""), text or ""))
    turns = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in own.items()}
    members, ends = {}, {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        line = tuple(turns.get(base, [])[:h] + turns[c][h:])
        for d in range(len(line) + 1):
            members.setdefault(line[:d], []).append(c)
        ends.setdefault(line, []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = kids.get(node, [])
        leaves[node] = sum(leaves[k] for k in below) or 1
        size = len(node[-1][1].encode()) if node else 0
        saved[node] = (len(members[node]) - 1) * size + sum(saved[k] for k in below)
    return sorted((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids.get(node, [])), leaves[node], saved[node],
                   sha(",".join(map(str, sorted(ends.get(node, [])))))) for node, m in members.items())


def answer(spark, rows, **more):
    frame = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA).repartition(4)
    got = X.prefix_trie(frame, **more)
    assert got.columns == COLUMNS
    return sorted(map(tuple, got.collect()))


def random_rows(seed, n=40):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 300), n):
        for t in range(rng.choice([1, 1, 2, 3, 5, 9, 14, 23])):
            # few words and long stretches in common: nested branches, ends inside edges
            rows.append((c, t, rng.choice(["u", "u", "u", "a"]), "x" if t % 3 or rng.random() < 0.6 else rng.choice("yzé")))
    return rows


@pytest.mark.parametrize("block,seed", [(64, 1), (4, 2), (1, 3)])
def test_matches_brute_force(spark, block, seed):
    rows = random_rows(seed)
    assert answer(spark, rows, block=block) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None, "u", "late"), (1, 0, None, None), (1, 0, "a", "tie"), (1, 0, "a", "tie"), (None, 1, "u", "no"), (2, 5, "", ""),
            (7, 1, "u", "x" * 100_000), (5, 1, "u", "x" * 100_000), (5, 1, "u", "x" * 99_999 + "y"), (None, None, None, None), (-3, 1, "u", "n"),
            (0, 1, "ab", "c"), (10, 1, "a", "bc")]
    assert answer(spark, rows) == brute(rows)
    assert answer(spark, []) == []


def test_one_long_and_many_equal_conversations(spark, monkeypatch):
    monkeypatch.setattr(X, "LONG_LIST", 16)
    rows = [(1000, t, "u", f"t{t}") for t in range(150)]
    rows += [(c, t, "u", f"hello {t}") for c in range(2, 90) for t in range(3)] + [(c, 9, "u", "bye") for c in range(20, 40)]
    assert answer(spark, rows, block=16) == brute(rows)


def test_two_fattest(spark):
    from pyspark.sql import functions as F
    pairs = [(a, b) for a in range(20) for b in range(a + 1, 21)]
    rows = spark.createDataFrame(pairs, "a int, b int").select("a", "b", X.two_fattest(F.col("a"), F.col("b")).alias("f")).collect()
    assert all(r.f == max(range(r.a + 1, r.b + 1), key=lambda x: x & -x) for r in rows)


def test_registered_query_matches_its_sql(spark):
    import duckdb

    from tidecast.llm import catalog
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    want = con.execute(catalog.oracle_sql()["op12_prefix_trie"])
    names = [c[0] for c in want.description]
    got = catalog.queries()["op12_prefix_trie"](spark, sf)
    assert sorted(names) == sorted(COLUMNS)
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)
