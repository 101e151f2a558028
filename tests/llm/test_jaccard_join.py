import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from tidecast.llm import components as C
from tidecast.llm import jaccard_join as X


def brute(rows):
    """{row: (n_shingles, component)} by an inverted index over all shingles."""
    sets = [X.word_set((t or "").encode()) for _, t in rows]
    where, parent = {}, list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for k, s in enumerate(sets):
        shared = Counter(j for x in s for j in where.get(x, ()))
        for j, both in shared.items():
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                parent[root(k)] = root(j)
        for x in s:
            where.setdefault(x, []).append(k)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((rows[k][0], len(s), least.get(root(k))) for k, s in enumerate(sets)), key=str)


def made_rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 5)))
    passage = [word() for _ in range(40)]
    rows, texts = [], []
    for _ in range(60):
        own = [word() for _ in range(rng.choice([3, 5, 6, 7, 9, 12, 20, 60, 150, 400]))]
        text = passage + own if rng.random() < 0.5 else own
        texts.append(text)
        for _ in range(rng.choice([0, 0, 1, 3, 9])):  # near copies
            copy = list(text)
            for _ in range(rng.randint(0, max(1, len(copy) // 30))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy if rng.random() < 0.7 else copy + own[:len(own) // 8])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "one"), (905, "a b c d"), (906, "A  b\nc d"),
             (5, rows[5][1]), (6, rows[7][1]), (None, "no id here at all today"), (None, rows[0][1]), (907, "x " * 3000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("cost", [32, 0.05])
def test_matches_brute_force(spark, cost):
    rows = made_rows()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, slack string, component long")
    got = sorted(map(tuple, X.jaccard_join(docs, run_cost=cost).collect()), key=str)
    want = [(i, n, c if n or i is None else i) for i, n, c in brute(rows)]
    assert got == want


def test_empty_table_and_choice(spark):
    assert X.jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(3, "a b c d e f"), (1, "a b c d e f"), (2, "g"), (4, None), (5, "")], "doc_id long, text string")
    assert sorted(r.doc_id for r in X.one_of_each(docs).collect()) == [1, 2, 4, 5]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200), (7, 7)]
    found = {r.node: r.component for r in C.connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
    assert C.connected(spark.createDataFrame([], "u long, v long")).count() == 0


def test_pairs_within_a_component_are_not_built():
    group = np.zeros(20_000, np.int64)
    group[[5, 70, 900]] = 1, 2, 2
    tracemalloc.start()
    found = [pair for i, j in X.cross_pairs(group, 1000) for pair in zip(i.tolist(), j.tolist(), strict=True)]
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    assert len(found) == len(set(found)) == 3 * 19_997 + 2
    assert all(i < j and group[i] != group[j] for i, j in found)


def test_crowded_shingles_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(X, "RARE_BLOCK", 3)
    rows = made_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prefixes = X._rare_prefixes(X._texts(docs))
    assert prefixes.where("crowd > 9").count()
    alone = spark.createDataFrame([], "node binary, component binary")
    pairs = X._dealt_pairs(prefixes, alone)
    content = X._texts(docs).rdd.map(lambda r: bytes(r.text)).collect()
    sets = {X.set_key(s): w for t in content for s, w in [(X.shingle_sets([X.words(t)])[0], X.word_set(t))] if len(s)}
    crowd = {}
    for r in prefixes.where("crowd is not null").collect():
        crowd.setdefault(r.shingle, set()).add(bytes(r.id))
    first = {}
    for r in prefixes.collect():
        first.setdefault(bytes(r.id), {})[r.shingle] = r.at
    want = set()
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                both = set(first[a]) & set(first[b])
                if min(both, key=lambda x: first[a][x]) in crowd:
                    want.add(frozenset((a, b)))
    got = {frozenset((bytes(r.a), bytes(r.b))) for r in pairs.collect()}
    assert want and want <= got


def test_copies_short_of_the_threshold_are_not_all_paired(spark, monkeypatch):
    rng = random.Random(11)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = []
    for i in range(120):
        copy = list(base)
        for at in rng.sample(range(200), 8):  # about 38 of 196 shingles: similarity 0.68 with the base
            copy[at] = f"own{i}x{at}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    compared, whole = [], X.linked
    monkeypatch.setattr(X, "linked", lambda pairs, content: compared.append(pairs.count()) or whole(pairs, content))
    got = sorted(map(tuple, X.jaccard_join(docs).collect()))
    assert got == sorted((i, n, c) for i, n, c in brute(rows))
    assert sum(compared) < 5 * len(rows)  # of 7,140 pairs


def test_sets_with_one_number_are_both_kept(spark):
    keys = [bytes([2] * 8 + [last] * 8) for last in (1, 3)] + [bytes([4] * 16)]  # numbers are of the first half
    met = spark.createDataFrame([(0, X.numbers(np.array([keys[0], keys[2]], "V16")).tobytes(), np.array([0], np.int64).tobytes(),
                                  np.array([0, 2], np.int32).tobytes())], X.MET)
    room = spark.createDataFrame([(bytearray(k), 10, 5, 0, 0) for k in keys],
                                 "set_key binary, n_shingles long, usable int, slack int, slack_low int")
    run = X.hopeful(met, room, 3).first()
    assert [bytes(run.ids)[i:i + 16] for i in (0, 16, 32)] == keys
    assert np.frombuffer(run.members, np.int32).tolist() == [0, 2, 4]


def test_own_and_rarest_shingles_without_a_join(spark):
    rows = made_rows()
    docs = spark.createDataFrame(rows + [(2000 + k, t) for k, (_, t) in enumerate(rows[:40])], "doc_id long, text string")
    texts = X._texts(docs)
    sets = {X.set_key(s): s.tolist() for _, t in rows for s in X.shingle_sets([X.words((t or "").encode())]) if len(s)}
    df = Counter(x for s in sets.values() for x in s)
    own = {k: sum(df[x] == 1 for x in s) for k, s in sets.items()}
    found = X._own(texts)
    assert {bytes(r.k): (r.own, r.n) for r in found.collect()} == {k: (c, len(sets[k])) for k, c in own.items() if c}
    rarest = X._rarest(texts, 5)
    assert {(bytes(r.id), r.n, r["at"], r.shingle % 2 ** 64) for r in rarest.collect()} == {
        (k, len(s), at, x) for k, s in sets.items() for at, x in enumerate(sorted(s, key=lambda x: (df[x], x))[:len(s) // 4 + 1])}
    assert rarest.count() == sum(len(s) // 4 + 1 for s in sets.values())
    for plan in (found, rarest):  # a row for each shingle of each set never passes a join
        assert "Join" not in plan._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_a_bucket_leave_in_batches(spark, monkeypatch):
    ids = np.arange(40, dtype=np.uint64).repeat(2).view("V16")
    run = {"bucket": 0, "ids": ids.tobytes(), "sizes": np.full(40, 8, np.uint32).tobytes(), "usable": np.full(40, 8, np.uint32).tobytes(),
           "scores": np.zeros(40, np.float32).tobytes(), "starts": np.array([0], np.int64).tobytes(),
           "members": (2 * np.arange(40)).astype(np.int32).tobytes()}
    runs = spark.createDataFrame([tuple(run.values())], X.RUNS)
    monkeypatch.setattr(X, "PAIR_ROWS", 64)
    none = spark.createDataFrame([], "node binary, component binary")
    pairs = X.open_pairs(runs, none, 32, 0, 1).where("b is not null").collect()
    names = [x.tobytes() for x in ids]
    assert {(bytes(r.a), bytes(r.b)) for r in pairs} == {(names[i], names[j]) for i in range(40) for j in range(i + 1, 40)}
    assert len(pairs) == 780 and {(r.low, r.n, r.least) for r in pairs} == {(None, 1, 6)}
    hot = X.open_pairs(runs, none, 1, 0, 1).collect()
    assert {(bytes(r.a), r.b, r.low, r.n, r.least) for r in hot} == {(x, None, 0, 1, None) for x in names}
