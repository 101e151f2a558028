"""License scans: MinHash bands over overlapping windows, exact containment.

A template of n words is looked for in windows of 2n words (at least n + 4)
that start every half of the rest, so that every stretch of text as long as the
template, with a few words more, lies whole in some window.  A window's MinHash
values are one-row bands: the chance that a window holding at least CONTAINMENT
of a template's shingles shares no band with it is below MISS for the number of
bands used, which is computed per template length and not tuned.  Windows that
share a band are verified exactly: the template's word shingles (of five words,
or the whole template if it is shorter) that the window holds are counted, and
the stretch from the first to the last of them is reported.

Words are maximal runs of letters and digits, lower-cased, so punctuation does
not matter.  Templates are few and of fixed size, so they go with the task;
documents are read once, in batches, and nothing is shuffled.

Defined results: null or empty text has no match; rows that repeat an id are
scanned on their own; a template that occurs several times is reported once per
stretch; stretches of one template do not overlap (the fullest, then the
first, stays); a null doc_id is kept; empty tables give empty results; other
columns are ignored; texts are scanned whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import WIDTH, hashed_words, mix, windows

CONTAINMENT = 0.75
MISS = 1e-3
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

# Short public licence notices and the opening words of licences.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                         "except in compliance with the License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
           "that the following conditions are met",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                  "General Public License as published by the Free Software Foundation",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                 "associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "public-domain": "This is free and unencumbered software released into the public domain.",
}


def split(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


@dataclass(frozen=True)
class Plan:
    """How templates of one number of words are looked for."""

    words: int
    names: tuple[str, ...]
    shingles: tuple[np.ndarray, ...]  # per template, distinct and sorted
    width: int                        # words of a shingle
    window: int                       # words of a window
    stride: int
    bands: int

    @property
    def spans(self) -> int:
        return self.window - self.width + 1


def bands_needed(similarity: float, miss: float = MISS) -> int:
    """One-row bands so that sets of that Jaccard similarity share none with at most chance ``miss``."""
    return max(1, math.ceil(math.log(miss) / math.log(1 - similarity))) if similarity < 1 else 1


def make_plans(templates: dict[str, str], containment: float = CONTAINMENT) -> list[Plan]:
    by_length: dict[int, list[tuple[str, list[bytes]]]] = {}
    for name, text in sorted(templates.items()):
        if found := split(text.encode()):
            by_length.setdefault(len(found), []).append((name, found))
    plans = []
    for n, group in sorted(by_length.items()):
        width = min(WIDTH, n)
        hashes, _ = hashed_words([w for _, w in group])
        shingles = tuple(np.unique(windows(hashes[i * n:(i + 1) * n], width)) for i in range(len(group)))
        window = max(2 * n, n + 4)
        stride = max(1, (window - n) // 2)
        held = containment * min(map(len, shingles))     # a window with so many of the template's shingles,
        union = (window - width + 1) + max(map(len, shingles)) - held  # all its other ones different
        plans.append(Plan(n, tuple(g[0] for g in group), shingles, width, window, stride, bands_needed(held / union)))
    return plans


def _salts(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def promising(spans: np.ndarray, starts: np.ndarray, plan: Plan, containment: float) -> np.ndarray:
    """The windows that hold as many template shingles as any match needs.  A position is
    looked at closely only if its hash's low bits are those of some template shingle."""
    known = np.unique(np.concatenate(plan.shingles))
    low = np.zeros(1 << 16, bool)
    low[known & np.uint64(0xFFFF)] = True
    maybe = np.flatnonzero(low[spans & np.uint64(0xFFFF)])
    at = maybe[np.isin(spans[maybe], known)]
    held = np.searchsorted(at, starts + plan.spans) - np.searchsorted(at, starts)
    return np.flatnonzero(held >= max(1, enough(containment, min(map(len, plan.shingles)))))


def enough(containment: float, shingles: int) -> int:
    """How many of a template's shingles are that share of them."""
    return math.ceil(containment * shingles - 1e-9)


def candidates(spans: np.ndarray, starts: np.ndarray, plan: Plan) -> np.ndarray:
    """Rows (window, template) that share a MinHash band; ``spans``: the shingles of a whole
    batch, ``starts``: where each window begins in them (all windows plan.spans long)."""
    pairs: list[np.ndarray] = []
    some = max(1, (1 << 20) // plan.spans)  # windows at once
    salts = _salts(plan.bands)
    # band by band the templates' values, sorted: a window's value is looked up in them
    values = np.array([[mix(shingles ^ salt).min() for shingles in plan.shingles] for salt in salts], np.uint64)
    order = np.argsort(values, axis=1, kind="stable")
    for i in range(0, len(starts), some):
        inside = spans[starts[i:i + some, None] + np.arange(plan.spans)]
        for band, salt in enumerate(salts):
            here = mix(inside ^ salt).min(axis=1)
            row = values[band, order[band]]
            first, last = np.searchsorted(row, here, "left"), np.searchsorted(row, here, "right")
            hit = np.flatnonzero(last > first)
            many = (last - first)[hit]
            place = np.repeat(first[hit], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            pairs.append(np.stack([np.repeat(hit, many) + i, order[band, place]], 1))
    return np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)


def stretches(part: np.ndarray, template: np.ndarray, need: int) -> list[tuple[int, int, int]]:
    """(first, last, distinct) of the runs of a window's positions that hold ``need`` distinct
    shingles of a template, none of them twice: at a repeat a run ends, and the next one
    starts behind the earlier place of the shingle that repeats.  Runs may overlap."""
    out, run = [], {}  # shingle -> position, in order of position
    for at in np.flatnonzero(np.isin(part, template)).tolist():
        shingle = int(part[at])
        if shingle in run:
            if len(run) >= need:
                out.append((next(iter(run.values())), next(reversed(run.values())), len(run)))
            earlier = run[shingle]
            run = {k: v for k, v in run.items() if v > earlier}
        run[shingle] = at
    if len(run) >= need:
        out.append((next(iter(run.values())), next(reversed(run.values())), len(run)))
    return out


def scan_batch(texts: list[bytes], plans: list[Plan], containment: float = CONTAINMENT) -> list[list[tuple]]:
    """Per text its matches (template, first word, end word, containment), ordered."""
    found = [split(t) for t in texts]
    hashes, lengths = hashed_words(found)
    ends = np.cumsum(lengths)
    out: list[list[tuple]] = [[] for _ in texts]
    for plan in plans:
        # texts shorter than a window get one window of padding words that no template has
        pad = plan.window
        at = np.arange(len(hashes)) + np.repeat(np.arange(len(texts)) * pad, lengths)
        wide = mix(np.arange(len(hashes) + pad * len(texts), dtype=np.uint64) + np.uint64(0xA5A5A5A5A5A5))
        wide[at] = hashes
        spans = windows(wide, plan.width)
        firsts = ends - lengths + np.arange(len(texts)) * pad
        count = np.where(lengths > 0, 1 + -(-np.maximum(lengths - plan.window, 0) // plan.stride), 0)
        of = np.repeat(np.arange(len(texts)), count)
        step = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        starts = firsts[of] + step * plan.stride
        starts = np.minimum(starts, len(spans) - plan.spans)
        matches: dict[tuple[int, int], dict[tuple[int, int], float]] = {}
        close = promising(spans, starts, plan, containment)
        for c, t in candidates(spans, starts[close], plan).tolist():
            w = close[c]
            first = int(starts[w] - firsts[of[w]])
            size = len(plan.shingles[t])
            for a, b, distinct in stretches(spans[starts[w]:starts[w] + plan.spans], plan.shingles[t], enough(containment, size)):
                matches.setdefault((int(of[w]), t), {})[first + a, first + b + plan.width] = distinct / size
        for (doc, t), places in matches.items():
            taken: list[tuple[int, int]] = []
            for (a, b), share in sorted(places.items(), key=lambda x: (-x[1], x[0][1] - x[0][0], x[0])):
                if all(b <= c or a >= d for c, d in taken):
                    taken.append((a, b))
                    out[doc].append((plan.names[t], a, b, share))
    return [sorted(m, key=lambda x: (x[1], x[2], x[0])) for m in out]


MATCHES = "array<struct<template: string, start: int, end: int, containment: double>>"


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id and matches, per row: the templates found and their stretch in words (end exclusive)."""
    plans = make_plans(TEMPLATES if templates is None else templates, containment)
    from .jaccard_join import chunks
    kind = pa.list_(pa.struct([("template", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, 1, 8 << 20):
            found = scan_batch(part.column(1).to_pylist(), plans, containment)
            named = [[dict(zip(("template", "start", "end", "containment"), m, strict=True)) for m in ms] for ms in found]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(named, kind)], ["doc_id", "matches"])
    text = F.coalesce("text", F.lit("")).cast("binary").alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(run, f"doc_id long, matches {MATCHES}")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_matches, templates (names, comma-joined in order of place) and spans
    (``template:start:end``, comma-joined)."""
    found = scan(docs)
    return found.select(
        "doc_id", F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.transform("matches", lambda m: m["template"]), ",").alias("templates"),
        F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["template"], m["start"].cast("string"),
                                                                  m["end"].cast("string"))), ",").alias("spans"))
