"""Hard negatives by Four-Russians scoring.

Vectors are integers: each component x is floor(256 * x).  An anchor's components are cut
into groups of eight dimensions; per group a table holds the sum of every subset of the
eight.  A candidate's components are packed as bit planes, one byte a plane and group, so a
byte is the index of a subset: the score is the sum over planes of twice-shifted sums of
look-ups (the top plane counts negative), the exact integer inner product.

Rows travel as packs of some thousands; anchors and candidates meet pack by pack in a grid of
tasks, each of which has a share of the anchors and a share of the candidates, and keeps
only the best so far of every anchor.  Two passes: the nearest rows of the anchor's own label
(positives; only rows of the same label are scored), then, per positive, the best rows
of other labels whose score lies in the positive's window.

Defined results: rows with a null vec_id, label or vector, or with a null or non-finite component, take no
part, nor do components whose scaled value does not fit a long; of rows that share a vec_id
the one with the smallest (label, vector) takes part; a shorter vector counts as filled up with
zeros; scores are exact while they fit a long; ties go to the smaller vec_id; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, shared_table

CANDIDATES = 4096   # rows a pack
ANCHORS = 256       # anchors a pack
STRIP = 512         # candidates scored at once
TABLES = 8          # anchor packs of a task whose tables are kept
PACK = "ids binary, labels binary, shape array<int>, body binary"
FOUND = "anchor_id long, k int, other_id long, score long"


# --- integers, tables, planes ------------------------------------------------------------

def subset_sums(ints: np.ndarray) -> np.ndarray:
    """(anchors, dimensions) -> (groups, 256, anchors): the sum of every subset of eight."""
    n, width = ints.shape
    groups = -(-width // 8)
    dims = np.zeros((n, groups * 8), np.int64)
    dims[:, :width] = ints
    dims = dims.reshape(n, groups, 8).transpose(1, 2, 0)
    sums = np.zeros((groups, 256, n), np.int64)
    for j in range(8):
        sums[:, 1 << j:2 << j] = sums[:, :1 << j] + dims[:, j, None]
    return sums


def bit_planes(ints: np.ndarray) -> np.ndarray:
    """(rows, dimensions) -> (planes, groups, rows): bytes of two's-complement bits."""
    widest = int(np.where(ints < 0, ~ints, ints).max(initial=0)).bit_length() + 1
    return np.stack([np.packbits(((ints >> b) & 1).astype(np.uint8), axis=1, bitorder="little").T for b in range(widest)])


def narrowest(sums: np.ndarray, planes: int) -> np.ndarray:
    """The table in 32 bits if no score over so many planes can leave them."""
    top = int(np.abs(sums).max(axis=1, initial=0).sum(axis=0).max(initial=0)) if sums.size else 0
    return sums.astype(np.int32) if top << (planes + 1) < 1 << 31 else sums


def scores(sums: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Exact inner products (rows, anchors) by shift-add look-ups."""
    n, anchors = planes.shape[2], sums.shape[2]
    total = np.zeros((n, anchors), sums.dtype)
    line = np.empty_like(total)
    for b in reversed(range(len(planes))):
        if b < len(planes) - 1:
            total <<= 1
        for g in range(min(planes.shape[1], len(sums))):
            np.take(sums[g], planes[b, g], axis=0, out=line, mode="clip")
            if b == len(planes) - 1:
                total -= line
            else:
                total += line
    return total


class Best:
    """The best ``top`` others (score high first, ties by smaller id) per anchor and slot, among
    scores from ``low`` to ``high``."""

    def __init__(self, low: np.ndarray, high: np.ndarray, top: int):
        self.low, self.high, self.top = low, high, top
        self.score = np.repeat(low[..., None], top, axis=2)
        self.ids = np.full(self.score.shape, np.iinfo(np.int64).max)  # this id: an empty place

    def meet(self, found: np.ndarray, ids: np.ndarray, allowed: np.ndarray, columns: np.ndarray) -> None:
        """Scores (rows, columns) of candidates ``ids``; ``columns`` are the anchors' places."""
        for k in range(self.low.shape[1]):
            last, last_id = self.score[columns, k, -1], self.ids[columns, k, -1]
            better = (found > last) | ((found == last) & (ids[:, None] < last_id))
            better &= allowed & (found <= self.high[columns, k])
            row, column = np.nonzero(better)
            if not len(row):
                continue
            touched, at = np.unique(column, return_inverse=True)
            place = np.concatenate([at, np.repeat(np.arange(len(touched)), self.top)])
            score = np.concatenate([found[row, column].astype(np.int64), self.score[columns[touched], k].ravel()])
            other = np.concatenate([ids[row], self.ids[columns[touched], k].ravel()])
            order = np.lexsort((other, ~score, place))
            place = place[order]
            rank = np.arange(len(place)) - np.searchsorted(place, place)
            keep = order[rank < self.top]
            self.score[columns[touched], k] = score[keep].reshape(-1, self.top)
            self.ids[columns[touched], k] = other[keep].reshape(-1, self.top)

    def rows(self, anchors: np.ndarray) -> pa.RecordBatch:
        a, k, r = np.nonzero(self.ids != np.iinfo(np.int64).max)
        return pa.RecordBatch.from_arrays([pa.array(anchors[a]), pa.array(k.astype(np.int32)), pa.array(self.ids[a, k, r]),
                                           pa.array(self.score[a, k, r])], ["anchor_id", "k", "other_id", "score"])


# --- packs ----------------------------------------------------------------------------------

def _ints(column: pa.Array) -> np.ndarray:
    """A list column as a matrix, shorter rows filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(lengths), max(1, int(lengths.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _packs(batches: Iterator[pa.RecordBatch], planes: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, labels, ints = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _ints(batch.column(2))
        if planes:
            order = np.argsort(ids)
            ids, labels, ints = ids[order], labels[order], bit_planes(ints[order])
        row = {"ids": ids.tobytes(), "labels": labels.tobytes(), "shape": list(ints.shape), "body": ints.tobytes()}
        if batch.num_columns > 3:
            row["wanted"] = _ints(batch.column(3)).tobytes()
            row["wanted_lengths"] = np.diff(batch.column(3).offsets.to_numpy()).astype(np.int64).tobytes()
        yield pa.RecordBatch.from_pylist([row], schema=_schema(batch.num_columns > 3))


def _schema(wanted: bool) -> pa.Schema:
    fields = [("ids", pa.binary()), ("labels", pa.binary()), ("shape", pa.list_(pa.int32())), ("body", pa.binary())]
    return pa.schema(fields + ([("wanted", pa.binary()), ("wanted_lengths", pa.binary())] if wanted else []))


def candidate_packs(rows: DataFrame) -> DataFrame:
    with arrow_rows(rows.sparkSession, CANDIDATES):
        return shared_table(rows.select("vec_id", "label", "ints").mapInArrow(lambda b: _packs(b, True), PACK), "negatives-packs")


def anchor_packs(rows: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    wide = PACK + (", wanted binary, wanted_lengths binary" if more else "")
    with arrow_rows(rows.sparkSession, ANCHORS):
        return shared_table(rows.select("vec_id", "label", "ints", *more).mapInArrow(lambda b: _packs(b, False), wide), "negatives-anchors")


def grid(anchors: DataFrame, packs: DataFrame) -> DataFrame:
    """Every anchor pack beside every candidate pack: both are dealt to ``side`` shares, and each
    pair of shares is one task's work."""
    n = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = max(1, math.ceil(math.sqrt(n)))
    key = F.xxhash64("ids")
    across = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    left = anchors.select(F.pmod(key, F.lit(side)).cast("int").alias("i"), across.alias("j"), F.struct("*").alias("anchor"))
    right = packs.select(F.pmod(key, F.lit(side)).cast("int").alias("j"), across.alias("i"), F.struct("*").alias("pack"))
    return left.repartition(side * side, "i", "j").join(right.repartition(side * side, "i", "j"), ["i", "j"]).select("anchor", "pack")


def _read(packs: pa.StructArray, i: int) -> dict:
    return packs[i].as_py()


def _matrix(row: dict, dtype: type) -> np.ndarray:
    return np.frombuffer(row["body"], dtype).reshape(row["shape"])


def _longs(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


class _Anchors:
    """One pack of anchors in a task: its tables, while it is at work, and what it has found so far."""

    def __init__(self, row: dict, top: int):
        self.ids, self.labels = _longs(row["ids"]), _longs(row["labels"])
        if "wanted" not in row:
            shape, edge = (len(self.ids), 1), np.iinfo(np.int64)
            self.best = Best(np.full(shape, edge.min), np.full(shape, edge.max), top)
            return
        lengths = _longs(row["wanted_lengths"])
        wanted = _longs(row["wanted"]).reshape(len(lengths), -1)
        low, high = np.ones(wanted.shape, np.int64), np.zeros(wanted.shape, np.int64)  # an empty window
        for a, n in enumerate(lengths):
            for k in range(n):  # 50 p <= 100 s <= 95 p in whole numbers of any size
                p = int(wanted[a, k])
                low[a, k], high[a, k] = -(-p // 2), 95 * p // 100
        self.best = Best(low, high, top)

    def set_up(self, row: dict, same: bool) -> None:
        self.sums = subset_sums(_matrix(row, np.int64))
        own = [(x, np.flatnonzero(self.labels == x)) for x in np.unique(self.labels)] if same else []
        self.parts = [(x, at, np.ascontiguousarray(self.sums[:, :, at])) for x, at in own]

    def put_away(self) -> None:
        self.sums = self.parts = None

    def same_label(self, ids: np.ndarray, labels: np.ndarray, planes: np.ndarray) -> None:
        for label, at, sums in self.parts:
            mine = np.flatnonzero(labels == label)
            sums = narrowest(sums, len(planes)) if len(mine) else sums
            for s in range(0, len(mine), STRIP):
                rows = mine[s:s + STRIP]
                found = scores(sums, planes[:, :, rows])
                self.best.meet(found, ids[rows], ids[rows][:, None] != self.ids[at], at)

    def other_labels(self, ids: np.ndarray, labels: np.ndarray, planes: np.ndarray) -> None:
        sums, every = narrowest(self.sums, len(planes)), np.arange(len(self.ids))
        for s in range(0, len(ids), STRIP):
            rows = slice(s, s + STRIP)
            self.best.meet(scores(sums, planes[:, :, rows]), ids[rows], labels[rows][:, None] != self.labels, every)


def _search(batches: Iterator[pa.RecordBatch], same: bool, top: int) -> Iterator[pa.RecordBatch]:
    seen: dict[bytes, _Anchors] = {}
    at_work: list[_Anchors] = []  # those whose tables are built
    for batch in batches:
        for i in range(batch.num_rows):
            key = batch.column(0).field("ids")[i].as_py()
            if key not in seen:
                seen[key] = _Anchors(_read(batch.column(0), i), top)
            now = seen[key]
            if now not in at_work:
                now.set_up(_read(batch.column(0), i), same)
                at_work.append(now)
                if len(at_work) > TABLES:
                    at_work.pop(0).put_away()
            pack = _read(batch.column(1), i)
            rows = _longs(pack["ids"]), _longs(pack["labels"]), _matrix(pack, np.uint8)
            (now.same_label if same else now.other_labels)(*rows)
    for anchors in seen.values():
        yield anchors.best.rows(anchors.ids)


def best_of_all(anchors: DataFrame, packs: DataFrame, same: bool, top: int) -> DataFrame:
    """The best over all packs: anchor_id, k, other_id, score, rank (from 1)."""
    with arrow_rows(anchors.sparkSession, 4):
        found = shared_table(grid(anchors, packs).mapInArrow(lambda b: _search(b, same, top), FOUND), "negatives-found")
    order = Window.partitionBy("anchor_id", "k").orderBy(F.col("score").desc(), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def scaled(embeddings: DataFrame) -> DataFrame:
    """The rows that take part: vec_id, label (long), ints."""
    def fits(x: Column) -> Column:
        big = F.abs(x.cast("double") * 256)
        return x.isNotNull() & ~F.isnan(x) & (big < float(2 ** 63))

    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("embedding", fits))
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    rows = rows.select(vec_id.alias("vec_id"), F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
                       F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("ints"))
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "ints")).alias("r"))
    return shared_table(one.select("vec_id", F.col("r.label").alias("label"), F.col("r.ints").alias("ints")), "negatives-rows")


def mine(embeddings: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3) -> DataFrame:
    """Hard negatives of the rows for which ``anchors`` holds: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score."""
    rows = scaled(embeddings)
    packs = candidate_packs(rows)
    asked = rows.where(anchors)
    near = shared_table(best_of_all(anchor_packs(asked), packs, True, positives).select(
        "anchor_id", F.col("other_id").alias("positive_id"), (F.col("rank") - 1).alias("k"), F.col("score").alias("positive_score")), "negatives-positives")
    lists = near.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("k", "positive_score"))).alias("near")).select(
        F.col("anchor_id").alias("vec_id"), F.transform("near", lambda s: s["positive_score"]).alias("wanted"))
    hard = best_of_all(anchor_packs(asked.join(lists, "vec_id"), ("wanted",)), packs, False, negatives)
    return hard.join(near, ["anchor_id", "k"]).select(
        "anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
