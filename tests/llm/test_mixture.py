import random
import re

import numpy as np
import pytest

from tidecast.llm import mixture as M


def brute_targets(sizes):
    """Shares are given out until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    total, held = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in held]
        rest = total - sum(held.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {**held, **share}
        held |= {s: 3.0 * sizes[s] for s in over}


def test_fit_is_the_best_subset_sum():
    rng = random.Random(1)
    for _ in range(60):
        lengths = np.array(sorted(rng.sample(range(1, 60), rng.randint(1, 8))))
        counts = np.array([rng.randint(1, 6) for _ in lengths])
        budget = rng.randint(0, int((lengths * counts).sum()) + 5)
        sums = {0}
        for size, n in zip(lengths.tolist(), counts.tolist()):
            sums = {s + k * size for s in sums for k in range(n + 1)}
        taken = M.fit_counts(lengths, counts, budget)
        assert ((0 <= taken) & (taken <= counts)).all()
        assert (taken * lengths).sum() == max(s for s in sums if s <= budget)
        near = M.fit_counts(lengths, counts, budget, dp_budget=40)  # bulk first, the program for the rest
        assert 0 <= budget - (near * lengths).sum() <= max(59, budget - max(s for s in sums if s <= budget))


def made():
    rng = random.Random(3)
    rows = []
    for i in range(600):
        source = rng.choice(["b", "b", "b", "b", "a", "ä", "Z", "", None])
        text = " ".join(["w"] * rng.choice([0, 1, 2, 3, 5, 8, 40, 300])) if rng.random() < 0.95 else None
        rows.append((i, text, source))
    return rows + [(1000, "tiny one", "zz"), (7, "again a b", "b"), (7, "again a b", "b"), (None, "no id", "a"), (8, "\t x \n y ", "a")]


def test_mix(spark):
    rows = made()
    docs = spark.createDataFrame([(i, t, s, 5) for i, t, s in rows], "doc_id long, text string, source string, size int")
    got = M.mix(docs).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), words(t)) for i, t, _ in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    want, taken = brute_targets(sizes), {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.repeats * r.size <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1, s
    assert sorted(map(str, M.mix(docs.repartition(3)).collect())) == sorted(map(str, got))
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.repeats for r in got)
    assert sum(words(r.text) for r in mixed.collect()) == sum(r.taken for r in got)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mix(none).count() == 0 and M.mixed_documents(none).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert {(r.doc_id, r.taken, r.target) for r in M.mix(blank).collect()} == {(1, 0, 0.0), (2, 0, 0.0)}
