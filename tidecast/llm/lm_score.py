"""Language-model scores of whole documents.

Counts of all training words come from one aggregation.  The most frequent
words form the recurrent model's vocabulary, which grows as the square root of
the number of different words (at least 1,024; see ``gru``); it is trained data-
parallel: in every round each partition runs truncated backpropagation over
its training texts from the same weights, and the weights are averaged by an
aggregation over their positions.  A word outside the vocabulary costs the
model's "unknown" times its share (count + 1) among the words outside.

Every training text goes through backpropagation once in each round.  Callers
may pass a smaller ``share`` of the texts (chosen by a hash of the id, a fresh
share each round); the registered query does not.

The counts of FREQUENT words (or of the vocabulary, if it is larger) are sent to
the scoring tasks; all rarer words of a text are matched by a join on their 64-bit hash.

Defined results: null or empty text is the end token alone; a null doc_id is
hashed as the empty text; rows that repeat an id count and score on their own;
without training texts N is 0 and the weights stay at their start; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import crc_mod, shared_table
from .jaccard_join import chunks
from .shingles import words

FREQUENT = 32_768
ROUNDS = 1
TRAIN_SHARE = 1.0   # of the training texts, in each round
PIECE_BYTES = 8 << 20
HELD_OUT = 2        # remainder of crc32(doc_id) modulo 7


def _prepared(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"),
                       (crc_mod("doc_id", 7) == HELD_OUT).alias("held_out"))


class _Hashes(dict):
    """64-bit hashes of words, computed once a word."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the texts' words, all texts in a row, and the texts' lengths in words."""
    split = [words(t) for t in texts]
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    hashes = map(_Hashes().__getitem__, chain.from_iterable(split))
    return np.fromiter(hashes, np.uint64, int(lengths.sum())), lengths


def word_counts(texts: DataFrame) -> DataFrame:
    """(text) -> word (64-bit hash), c.  Words are counted per batch before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, 0, PIECE_BYTES):
            hashes, _ = hashed_words(part.column(0).to_pylist())
            word, count = np.unique(hashes.view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(count, pa.int64())], ["word", "c"])
    return texts.select("text").mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Frequent:
    """Counts and vocabulary ids of the most frequent words, by hash."""

    def __init__(self, rows: list[tuple[int, int]], vocabulary: int):
        hashes = np.array([w for w, _ in rows], np.int64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.counts = np.array([c for _, c in rows], np.int64)[order]
        ids = np.arange(len(rows)) + 2  # in order of frequency, after END and UNKNOWN
        self.ids = np.where(ids < vocabulary, ids, gru.UNKNOWN)[order]

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vocabulary id and count of each word; count -1: not among the frequent."""
        if not len(self.hashes):
            return np.full(len(hashes), gru.UNKNOWN), np.full(len(hashes), -1)
        hashes = hashes.view(np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes
        return np.where(hit, self.ids[at], gru.UNKNOWN), np.where(hit, self.counts[at], -1)


def train_model(texts: DataFrame, frequent: Frequent, start: gru.Params, rounds: int = ROUNDS,
                share: float = TRAIN_SHARE) -> gru.Params:
    """Rounds of data-parallel training on (doc_id, text), or a share of them."""
    model = start
    for turn in range(rounds):
        drawn = F.pmod(F.xxhash64(F.lit(turn), "doc_id"), F.lit(10_000)) < int(10_000 * share)

        def run(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            streams = []
            for part in chunks(batches, 0, PIECE_BYTES):
                hashes, lengths = hashed_words(part.column(0).to_pylist())
                ids, _ = frequent.look_up(hashes)
                streams.append(np.insert(ids.astype(np.int32), np.cumsum(lengths), gru.END))  # a partition's ids are held at once
            stream = np.concatenate(streams) if streams else np.zeros(0, np.int32)
            if len(stream):
                values = gru.flat(gru.train(model, stream))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values, pa.float32()),
                                                  pa.array(np.full(len(values), len(stream)), pa.int64())], ["at", "value", "n"])
        parts = texts.where(drawn).select("text").mapInArrow(run, "at int, value float, n long")
        mean = parts.groupBy("at").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("value"))
        values = mean.toPandas()  # one row per weight
        if len(values):
            model = gru.shaped(values.sort_values("at")["value"].to_numpy(np.float32), model)
    return model


def score_documents(docs: DataFrame, rounds: int = ROUNDS, share: float = TRAIN_SHARE, frequent_words: int = FREQUENT) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    texts = _prepared(docs)
    learned = texts.where("not held_out")
    counts = shared_table(word_counts(learned), "lm-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    ends = learned.count()
    n, v = total + ends, distinct + (1 if ends else 0)
    vocabulary = gru.side_for(distinct) ** 2
    # a fixed number of rows, or one for each word of the vocabulary (the square root of the words)
    top = counts.orderBy(F.desc("c"), "word").limit(max(frequent_words, vocabulary - 2)).collect()
    frequent = Frequent([tuple(r) for r in top], vocabulary)
    inside = [c for _, c in top[:vocabulary - 2]]
    outside, kinds = total - sum(inside), distinct - len(inside)
    by_id = np.zeros(vocabulary)
    by_id[gru.END], by_id[gru.UNKNOWN], by_id[2:2 + len(inside)] = ends, outside, inside
    model = train_model(learned, frequent, gru.initial(by_id), rounds, share)
    base_unit, outside_unit, end_log = math.log10(n + v + 1), math.log10(outside + kinds + 1), math.log10(ends + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, 1, PIECE_BYTES):
            hashes, lengths = hashed_words(part.column(1).to_pylist())
            ids, found = frequent.look_up(hashes)
            of = np.repeat(np.arange(len(lengths)), lengths)
            logs = np.log10(np.maximum(found, 0) + 1.0)
            other = ids == gru.UNKNOWN
            sums = lambda weights: np.bincount(of, weights=weights, minlength=len(lengths))
            ends_at = np.cumsum(lengths)
            streams = [np.r_[ids[e - k:e], gru.END] for e, k in zip(ends_at.tolist(), lengths.tolist(), strict=True)]
            base = sums(logs) + end_log - (lengths + 1) * base_unit
            scored = gru.score(model, streams) / math.log(10) + sums(np.where(other, logs - outside_unit, 0.0))
            rare = np.flatnonzero(found < 0)
            order = rare[np.lexsort((hashes[rare], of[rare]))]
            doc, word = of[order], hashes[order].view(np.int64)
            first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])]) if len(order) else order
            times = np.diff(np.r_[first, len(order)])
            offsets = np.searchsorted(doc[first], np.arange(len(lengths) + 1))
            listed = lambda x, kind: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, kind))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(lengths + 1, pa.int64()),
                 pa.array(sums((found > 0).astype(float)).astype(np.int64) + (1 if ends else 0), pa.int64()),
                 pa.array(base), pa.array(scored), listed(word[first], pa.int64()), listed(times, pa.int32())],
                ["doc_id", "held_out", "n_tokens", "known", "base", "scored", "rare", "times"])

    schema = ("doc_id long, held_out boolean, n_tokens long, known long, base double, scored double, "
              "rare array<long>, times array<int>")
    scored = shared_table(texts.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select(
        "row", F.col("x.rare").alias("rare"), F.col("x.times").alias("times"))
    rest = rare.join(counts, F.col("rare") == F.col("word")).groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more"), F.sum("times").alias("met")).withColumnRenamed("row", "of")
    more, met = F.coalesce("more", F.lit(0.0)), F.coalesce("met", F.lit(0))
    return scored.join(rest, F.col("row") == F.col("of"), "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + met).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("scored") + more).alias("score"))
