import math

import numpy as np
from pyspark.sql import functions as F

from tidecast.llm import neighbours as X

SCHEMA = "vec_id long, embedding array<float>, node long, vector string"


def brute(rows, places=10):
    seen = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            seen.setdefault((i, tuple(np.float32(v).tolist())))
    out = {}
    for i, v in seen:
        if i % 100 == 0:
            far = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w))), j) for j, w in seen if j != i)
            out[i] = far[:places]
    return out


def answers(spark, rows, **more):
    frame = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], SCHEMA)
    got = {}
    for r in sorted(X.nearest(frame, F.col("vec_id") % 100 == 0, **more).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    return got


def test_small_tables_are_exact(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [1.0, 2.0]),
            (5, [1.0, 2.0]), (6, []), (None, [1.0, 1.0]), (7, [4.0, 6.0]), (100, [4.0, 6.0]), (8, [float("inf"), 0.0])]
    rows += [(1000 + 2 * i + 1, [3.0, 3.0]) for i in range(40)] + [(200, [3.0, 3.0])]
    got, want = answers(spark, rows), brute(rows)
    assert got.keys() == want.keys()
    for q in want:
        assert [j for _, j in got[q]] == [j for _, j in want[q]]
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]])
    assert answers(spark, [(0, [1.0])]) == {}
    assert X.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0).count() == 0


def test_recall_on_embeddings(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("vec_id < 1200")
    rows = [tuple(r) for r in frame.select("vec_id", "embedding").collect()]
    want = brute(rows)
    got = {}
    for r in X.nearest(frame, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(got[q] & {j for _, j in w}) for q, w in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_more_clusters_than_entry_nodes(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(160, 8)) * 100  # 30 vectors each, so all links stay inside; few entries reach them
    rows = [(i, (centres[i % 160] + rng.normal(size=8) * 0.01).astype(np.float32).tolist()) for i in range(4800)]
    want = brute(rows)
    got = answers(spark, rows, entries=8)
    hits = sum(len({j for _, j in got.get(q, ())} & {j for _, j in w}) for q, w in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
