import math
import zlib
from collections import Counter

import numpy as np

from tidecast.llm import gru
from tidecast.llm import lm_score as L


def base_scores(rows):
    tokens = [(t or "").encode().lower().split() for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    counts, ends = Counter(), 0
    for w, h in zip(tokens, held):
        if not h:
            counts.update(w)
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    unit = math.log10(n + v + 1)
    return [(i, h, len(w) + 1, sum(counts[x] > 0 for x in w) + (ends > 0), n,
             sum(math.log10(counts[x] + 1) - unit for x in w) + math.log10(ends + 1) - unit)
            for (i, _), w, h in zip(rows, tokens, held)]


def check(frame, rows, **more):
    got = L.score_documents(frame, **more).collect()
    key = lambda r: (str(r[0]), r[2], round(r[5], 4))
    want = sorted(base_scores(rows), key=key)
    got = sorted(got, key=lambda r: (str(r.doc_id), r.n_tokens, round(r.base_score, 4)))
    for g, w in zip(got, want, strict=True):
        assert (g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens) == w[:5]
        assert math.isclose(g.base_score, w[5], rel_tol=1e-9, abs_tol=1e-9)
    return got


def test_documents_beat_the_base(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    got = check(frame, rows, share=0.3, frequent_words=2000)  # words beyond the frequent go through the join
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, "A a B\tb"), (None, "x y z"), (3, "word " * 3000), (4, "É é"), (5, "new"), (5, "new")]
    frame = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    got = check(frame, rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert L.score_documents(frame.limit(0)).count() == 0


def test_state_is_carried_across_windows():
    rng = np.random.default_rng(0)
    p = gru.initial(rng.integers(1, 50, gru.VOCABULARY))
    texts = [np.r_[rng.integers(1, gru.VOCABULARY, n), gru.END] for n in (0, 1, 63, 64, 65, 300, 1000)]
    got = gru.score(p, texts)
    for t, g in zip(texts, got):
        before = np.r_[gru.END, t[:-1]][:, None]
        h = gru.states(p, before, np.zeros((1, gru.HIDDEN), np.float32))[:, 0]
        assert math.isclose(g, gru.log_probability(p, h, t).sum(), rel_tol=1e-4)
    # a distribution: the next words' probabilities sum to one
    h = np.repeat(h[-1:], gru.VOCABULARY, 0)
    assert math.isclose(np.exp(gru.log_probability(p, h, np.arange(gru.VOCABULARY))).sum(), 1, rel_tol=1e-4)


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in gru.initial(rng.integers(0, 90, gru.VOCABULARY)).items()}
    x, y = rng.integers(0, 9, (5, 3)), rng.integers(0, gru.VOCABULARY, (5, 3))
    h = rng.normal(size=(3, gru.HIDDEN)) * 0.1
    grads, _, _ = gru.window_gradients(p, x, y, h)
    for k in p:
        i = int(np.abs(grads[k]).ravel().argmax())
        sides = []
        for step in (1e-3, -1e-3):
            q = {n: v.copy() for n, v in p.items()}
            q[k].ravel()[i] += step
            sides.append(gru.window_gradients(q, x, y, h)[1])
        assert math.isclose(grads[k].ravel()[i], (sides[0] - sides[1]) / 2e-3, rel_tol=1e-3)


def test_training_lowers_the_loss():
    rng = np.random.default_rng(2)
    stream = np.tile(np.r_[rng.integers(2, 40, 30), gru.END], 400)
    p = gru.initial(np.bincount(stream, minlength=gru.VOCABULARY))
    text = stream[:31]
    assert gru.score(gru.train(p, stream), [text])[0] > gru.score(p, [text])[0] + 5


def test_every_training_text_is_learned(spark):
    order = np.random.default_rng(4).permutation(60)
    ids = [i for i in range(1, 40) if zlib.crc32(str(i).encode()) % 7 != 2][:3]
    texts = [" ".join(f"w{i}x{k}" for k in order) + " " for i in ids]
    rows = [(i, t * 250) for i, t in zip(ids, texts, strict=True)]  # each text has an order of its own words
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for r in L.score_documents(frame).collect():  # production parameters; untrained weights are near the base
        assert r.score > 0.8 * r.base_score, r.doc_id


def test_no_id_of_a_stream_is_left_out():
    rng = np.random.default_rng(6)
    p = gru.initial(rng.integers(1, 50, gru.VOCABULARY))
    stream = rng.integers(2, 40, gru.LANES * gru.WINDOW + gru.LANES - 1)
    other = stream.copy()
    other[-1] = 900
    assert not np.array_equal(gru.train(p, stream)["w"], gru.train(p, other)["w"])
