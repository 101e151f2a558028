import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.llm import hard_negatives as X

SCHEMA = "vec_id long, embedding array<double>, label int, ints string, rank long"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows):
    part = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        row = (label, [math.floor(256 * x) for x in v])
        part[i] = min(part.get(i, row), row)
    out = []
    for a, (label, v) in part.items():
        if a % 50:
            continue
        score = sorted((-sum(x * y for x, y in zip(v, w)), j) for j, (_, w) in part.items() if j != a)
        for s, p in [(s, j) for s, j in score if part[j][0] == label][:5]:
            fit = [(t, j) for t, j in score if part[j][0] != label and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a, p, r, j, -s, -t) for r, (t, j) in enumerate(fit, 1)]
    return sorted(out)


def answer(spark, rows):
    frame = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], SCHEMA).repartition(3)
    got = X.mine(frame, F.col("vec_id") % 50 == 0)
    assert got.columns == COLUMNS
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("width,labels,size", [(64, 10, 1), (9, 3, 1), (3, 2, 1e6)])
def test_matches_brute_force(spark, monkeypatch, width, labels, size):
    monkeypatch.setattr(X, "CANDIDATES", 70)
    monkeypatch.setattr(X, "ANCHORS", 4)
    monkeypatch.setattr(X, "STRIP", 16)
    rng = np.random.default_rng(width)
    rows = [(i, (rng.normal(size=width) * 0.4 * size).tolist(), int(rng.integers(labels))) for i in range(-50, 550)]
    want = brute(rows)
    assert len(want) > 50
    assert answer(spark, rows) == want


def test_odd_rows_and_ties(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.0, 0.5, 1.0]) for _ in range(rng.choice([0, 2, 5, 11]))], rng.randrange(3)) for i in range(300)]
    rows += [(400, [1.0, 1.0], 1)] * 3 + [(401, [1.0, 0.5], None), (None, [1.0], 1), (402, None, 2), (403, [1.0, None], 0),
                                          (404, [float("nan")], 0), (405, [float("inf")], 1), (450, [], 1), (406, [-1.0, 0.25], 1)]
    rows += [(500 + i, [0.5, 0.5], i % 2) for i in range(60)]
    assert answer(spark, rows) == brute(rows)
    assert answer(spark, []) == []


def test_scores_are_exact():
    rng = np.random.default_rng(0)
    for top in (1, 300, 2 ** 27):
        a, b = rng.integers(-top, top + 1, (7, 19)), rng.integers(-top, top + 1, (33, 19))
        planes = X.bit_planes(b)
        assert (X.scores(X.narrowest(X.subset_sums(a), len(planes)), planes) == b @ a.T).all()


def test_registered_query_matches_its_sql(spark):
    import duckdb

    from tidecast.llm import catalog
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    want = con.execute(catalog.oracle_sql()["op13_hard_negatives"])
    names = [c[0] for c in want.description]
    got = catalog.queries()["op13_hard_negatives"](spark, sf)
    assert sorted(names) == sorted(COLUMNS)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
