import random

import numpy as np
import pytest

from tidecast.llm import license_scan as L


def brute(text, containment=L.CONTAINMENT):
    """Templates of which some window of 2n words holds enough shingles, by trying every window."""
    words = L.split((text or "").encode())
    found = set()
    for name, template in L.TEMPLATES.items():
        t = L.split(template.encode())
        width = min(L.WIDTH, len(t))
        wanted = {tuple(t[i:i + width]) for i in range(len(t) - width + 1)}
        spans = [tuple(words[i:i + width]) for i in range(len(words) - width + 1)]
        best = max((len(wanted & set(spans[i:i + len(t) - width + 1 + 1])) for i in range(max(1, len(spans)))), default=0)
        if best >= containment * len(wanted):
            found.add(name)
    return found


def made(rng):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    out = []
    for _ in range(rng.randint(0, 4)):
        out += [word() for _ in range(rng.randint(0, 200))]
        if rng.random() < 0.7:
            t = rng.choice(list(L.TEMPLATES.values())).split()
            if len(t) > 12 and rng.random() < 0.5:
                t[rng.randrange(3)] = word()
            out += t if rng.random() < 0.8 else [x.upper() + "!" for x in t]
    return " ".join(out)


def test_finds_what_brute_force_finds():
    rng = random.Random(4)
    texts = [made(rng) for _ in range(300)] + ["", " ", *L.TEMPLATES.values(), "x " * 3000 + "All  rights\nRESERVED"]
    got = L.scan_batch([t.encode() for t in texts], L.make_plans(L.TEMPLATES))
    for text, matches in zip(texts, got, strict=True):
        names = {m[0] for m in matches}
        assert brute(text) <= names, text[:80]
        words = L.split(text.encode())
        for name, a, b, share in matches:  # and each report is a true one
            t = L.split(L.TEMPLATES[name].encode())
            width = min(L.WIDTH, len(t))
            wanted = {tuple(t[i:i + width]) for i in range(len(t) - width + 1)}
            held = {tuple(words[i:i + width]) for i in range(a, b - width + 1)} & wanted
            assert len(held) / len(wanted) == pytest.approx(share) and share >= L.CONTAINMENT


def test_band_chance_is_met():
    rng = random.Random(8)
    templates = {f"t{i}": " ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for i in range(300)}
    plans = L.make_plans(templates)
    texts = []
    for t in templates.values():  # three quarters of the shingles left, at the least
        w = t.split()
        w[rng.randrange(1, 4)] = "other"
        texts.append(" ".join(["pad"] * rng.randrange(60) + w + ["tail"] * rng.randrange(60)).encode())
    got = L.scan_batch(texts, plans)
    assert sum(any(m[0] == f"t{i}" for m in ms) for i, ms in enumerate(got)) >= 299


def test_frames(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License.", 1), (None, None, 2), (2, "", 3), (1, "all rights reserved", 4)],
                                 "doc_id long, text string, matches int")
    got = sorted(map(tuple, L.report(docs).collect()), key=str)
    assert got == sorted([(1, 1, "mit", "mit:0:5"), (None, 0, "", ""), (2, 0, "", ""),
                          (1, 1, "all-rights-reserved", "all-rights-reserved:0:3")], key=str)
    assert L.report(docs.limit(0)).count() == 0


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in L.scan(docs).collect():
        assert {m.template for m in r.matches} >= brute(texts[r.doc_id])


def test_every_repeat_is_a_match():
    plans = L.make_plans(L.TEMPLATES)
    short = min(L.TEMPLATES, key=lambda n: len(L.split(L.TEMPLATES[n].encode())))
    long = max(L.TEMPLATES, key=lambda n: len(L.split(L.TEMPLATES[n].encode())))
    for name in (short, long):
        notice = L.TEMPLATES[name]
        n = len(L.split(notice.encode()))
        for copies in (1, 2, 5):
            text = ("before it " + " ".join([notice] * copies) + " and after").encode()
            got = [m[1:3] for m in L.scan_batch([text], plans)[0] if m[0] == name]
            assert got == [(2 + i * n, 2 + (i + 1) * n) for i in range(copies)], (name, copies)


def test_five_hundred_templates():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    templates = {f"L{i}": " ".join(rng.choices(words, k=rng.choice([20, 60, 300]))) for i in range(500)}
    plans = L.make_plans(templates)
    picked = rng.sample(sorted(templates), 12)
    texts = [" ".join([*rng.choices(words, k=50), templates[n], *rng.choices(words, k=50)]).encode() for n in picked]
    for name, matches in zip(picked, L.scan_batch(texts, plans), strict=True):
        size = len(templates[name].split())
        assert [m[:3] for m in matches] == [(name, 50, 50 + size)] and matches[0][3] == 1.0


def test_only_windows_that_cannot_match_are_skipped():
    """With every window kept the matches are the same."""
    rng = random.Random(8)
    plans = L.make_plans(L.TEMPLATES)
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(4)):
            words = rng.choice(list(L.TEMPLATES.values())).split()
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = "other"
            parts += words + [f"x{rng.randrange(50)}" for _ in range(rng.randrange(12))]
        texts.append(" ".join(parts).encode())
    got = L.scan_batch(texts, plans)
    keep, L.promising = L.promising, lambda spans, starts, plan, containment: np.arange(len(starts))
    try:
        assert L.scan_batch(texts, plans) == got and any(got)
    finally:
        L.promising = keep
