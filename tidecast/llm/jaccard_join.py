"""Exact similarity join of documents on word shingles by universe partition.

The universe of shingles is hashed into m segments, m by size band.  Two sets
with Jaccard similarity t differ in at most H shingles, so of more than H
segments at least one is equal in both (pigeonhole).  A document's signatures
are the hashes of its shingles in each segment, for the band of its size and
for the band below if a partner may lie there.

Allocation by cost: an empty segment and a segment whose signature would bring
up too many pairs for its members ("hot") are not used.  A document is settled
while more than H usable segments are left.  Unsettled documents go to a second
partition with one-deletion neighbourhoods (a segment then bears one difference
and counts twice), and those unsettled there to a join on their rarest
shingles, which has no skipping (crowded shingles are dealt as pairs of blocks).  A pair is lost only if both documents were
unsettled, and then the next step meets it: the join is exact at every size.

Signatures are dealt to buckets in packed arrays; a bucket's task sorts its
numbers and keeps the runs of equal signatures.  Equal sets are one entity
(128-bit key).  Buckets and entities exchange packed messages (``answered``).
An entity leaves the runs of a band in which it shares fewer signatures with
others than with any similar set.  First every entity is compared with one that
shares most of its signatures, and linked entities become components; then all
pairs of a run that lie in different components are compared, except pairs that
are both unsettled, which the next step meets.  There a set's shingles that no
other unsettled set has bound what it can share with any of them.  A comparison
reads both whole texts and intersects their shingles as words, not hashes.

Defined results: null or empty text has no shingles and links with nothing
(component: its own doc_id, or null for a null doc_id); rows that repeat an id
are documents of their own; a component's id is its smallest doc_id, nulls
left aside; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, parted, shared_table
from .components import connected
from .shingles import WIDTH, distinct, mix, shingle_sets, words

SEGMENTS, DELETION_SEGMENTS = 0.40, 0.30  # segments per largest size of a band
RUN_COST = 32        # a run is hot with more than so many open pairs per member
BUCKET_BYTES = 16 << 20
PART_ENTITIES = 1 << 14  # entities whose messages a task holds at once
PAIR_BLOCK = 1 << 20  # pairs that a task holds at once
PAIR_ROWS = 1 << 16   # pairs that a task sends on at once
RARE_BLOCK = 1024     # members of a rare shingle's block; larger runs are dealt as pairs of blocks
ARROW_ROWS = 1000     # rows that a Python task receives at once
CHUNK = 8192         # texts whose signatures are packed together
BATCH_BYTES = 4 << 20


def band_of(n: int) -> int:
    return n.bit_length() - 1


def segments(band: int, level: int) -> int:
    return int((DELETION_SEGMENTS if level else SEGMENTS) * 2 ** (band + 1)) + 4


def roles(n: int) -> list[tuple[int, int]]:
    """(band, most differences) of a set of n shingles: its own band, where a
    partner is at most 4/3 n, and the band below if a partner of 3/4 n fits there.
    Similarity 3/4 leaves at most a seventh of both sizes to differ."""
    band = band_of(n)
    out = [(band, n // 3)]
    if band and 3 * n <= 4 * (2 ** band - 1):
        out.append((band - 1, (2 ** band - 1 + n) // 7))
    return out


def _placed(sets: list[np.ndarray], bands: np.ndarray, level: int):
    """Segment and value of every shingle of every set in its band, all sets in a row."""
    lengths = np.fromiter(map(len, sets), np.int64, len(sets))
    of = np.repeat(np.arange(len(sets)), lengths)
    parts = np.array([segments(b, level) for b in bands.tolist()], np.int64)
    first = np.r_[0, np.cumsum(parts)]
    seed = (bands.astype(np.uint64) * np.uint64(4) + np.uint64(level + 1)) * np.uint64(0x9E3779B97F4A7C15)
    salt = seed[of]
    placed = mix(np.concatenate(sets) ^ salt)
    at = first[of] + ((placed >> np.uint64(32)) % parts[of].astype(np.uint64)).astype(np.int64)
    return of, parts, first, seed, at, placed + salt


def capacities(sets: list[np.ndarray], bands: np.ndarray, level: int) -> np.ndarray:
    """How many differences the usable segments of each set stand for in its band."""
    if not len(sets):
        return np.zeros(0, np.int64)
    _, _, first, _, at, _ = _placed(sets, bands, level)
    size = np.minimum(np.bincount(at, minlength=first[-1]), level + 1)
    return np.add.reduceat(size, first[:-1])


def signatures(sets: list[np.ndarray], bands: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of all sets in their bands, and whose each is.  Level 1 adds the
    one-deletion neighbourhoods of segments with two or more shingles."""
    if not len(sets):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    of, parts, first, seed, at, raw = _placed(sets, bands, level)
    value = mix(raw)
    sums = np.zeros(first[-1], np.uint64)
    np.add.at(sums, at, value)
    size = np.bincount(at, minlength=first[-1])
    whose = np.repeat(np.arange(len(sets)), parts)
    base = mix((np.arange(first[-1]) - first[whose]).astype(np.uint64) + seed[whose] * np.uint64(3))
    used = np.flatnonzero(size)
    keys, owner = mix(sums[used] + base[used]), whose[used]
    if not level:
        return keys, owner
    more = size[at] > 1
    deleted = mix(sums[at[more]] - value[more] + base[at[more]])
    return np.concatenate([keys, deleted]), np.concatenate([owner, of[more]])


def rooms(sets: list[np.ndarray], level: int) -> tuple[np.ndarray, np.ndarray]:
    """Per set what its usable segments bear beyond its need, in its own band and the one
    below (a large number where it has no such role)."""
    out = np.full((2, len(sets)), 1 << 30, np.int64)
    todo = [(low, i, band, most) for i, s in enumerate(sets) if len(s) for low, (band, most) in enumerate(roles(len(s)))]
    if todo:
        low, at, band, most = (np.array(x) for x in zip(*todo, strict=True))
        out[low, at] = capacities([sets[i] for i in at.tolist()], band, level) - most - 1
    return out[0], out[1]


def set_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def chunks(batches: Iterator[pa.RecordBatch], text: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a piece has at most CHUNK texts and about ``most`` bytes of them."""
    for batch in batches:
        column, start, held = batch.column(text), 0, 0
        sizes = [len(v) if v is not None else 0 for v in (x.as_buffer() for x in column)]
        for i, size in enumerate(sizes):
            if i > start and (i - start >= CHUNK or held + size > most):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce("text", F.lit("")).cast("binary").alias("text"))


SETS = "doc_id long, n_shingles long, set_key binary, slack int, slack_low int"


def describe(docs: DataFrame) -> DataFrame:
    """Per row: the size and key of its set, and how many usable segments it has
    beyond those it needs, in its own band and the one below."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, 1):
            sets = shingle_sets([words(t) for t in part.column(1).to_pylist()])
            own, low = rooms(sets, 0)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()),
                 pa.array(own, pa.int32()), pa.array(low, pa.int32())],
                ["doc_id", "n_shingles", "set_key", "slack", "slack_low"])
    return _texts(docs).mapInArrow(run, SETS)


def numbers(keys: np.ndarray) -> np.ndarray:
    """64-bit numbers of set keys, even: the last bit tells the role."""
    return np.ascontiguousarray(keys).view(np.uint64)[::2] & ~np.uint64(1)


def pack(texts: DataFrame, level: int, buckets: int) -> DataFrame:
    """The signatures of all texts (binary column ``text``) as (bucket, body): signatures,
    and the number (with the role) of the set of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, 0):
            known: dict[bytes, np.ndarray] = {}
            for x in shingle_sets([words(t) for t in part.column(0).to_pylist()]):
                if len(x):
                    known.setdefault(set_key(x), x)
            if not known:
                continue
            sets = list(known.values())
            todo = [(i, low, band) for i, x in enumerate(sets) for low, (band, _) in enumerate(roles(len(x)))]
            which, low, band = (np.array(x, np.int64) for x in zip(*todo, strict=True))
            key, owner = signatures([sets[i] for i in which.tolist()], band, level)
            number = (numbers(np.array(list(known), dtype="V16"))[which] | low.astype(np.uint64))[owner]
            bucket = (key % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            key, number, bucket = key[order], number[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            key = np.ascontiguousarray(key.view(np.uint8).reshape(-1, 8)[:, 3:])  # 40 bits of it, among a bucket's
            bodies = [k.tobytes() + n.tobytes() for k, n in zip(np.split(key, cuts), np.split(number, cuts), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[np.r_[0, cuts]], pa.int32()), pa.array(bodies, pa.binary())], ["bucket", "body"])
    return texts.select("text").mapInArrow(run, "bucket int, body binary")


OPEN = "a binary, b binary, low int, n long, least long"
RUNS = "bucket int, ids binary, sizes binary, usable binary, scores binary, starts binary, members binary"
MET = "bucket int, ids binary, starts binary, members binary"


def _whole_runs(run: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of members sorted by run, the runs of two or more that are not all of the lower role
    (two sets that both have it meet in their own band)."""
    if not len(run):
        return run, member
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    count = np.diff(np.r_[starts, len(run)])
    keep = np.repeat((count > 1) & (np.minimum.reduceat(member & 1, starts) == 0), count)
    return run[keep], member[keep]


def _runs_of(bucket: int, bodies: list[bytes]) -> dict | None:
    """The runs of equal signatures in a bucket that two or more entities share; ids are numbers."""
    keys = np.concatenate([np.frombuffer(body, np.uint8, len(body) // 13 * 5).reshape(-1, 5) for body in bodies])
    number = np.concatenate([np.frombuffer(body, np.uint64, offset=len(body) // 13 * 5) for body in bodies])
    key = np.zeros((len(keys), 8), np.uint8)
    key[:, 3:] = keys
    key = key.view(np.uint64).ravel()
    order = np.argsort(key)
    key, number = key[order], number[order]
    same = key[1:] == key[:-1]
    keep = np.r_[False, same] | np.r_[same, False]
    key, number = key[keep], number[keep]
    if not len(key):
        return None
    name = distinct(number >> np.uint64(1))
    entity = 2 * np.searchsorted(name, number >> np.uint64(1)) + (number & np.uint64(1)).astype(np.int64)
    run = np.cumsum(np.r_[0, key[1:] != key[:-1]])
    run, entity = np.divmod(distinct(run * (2 * len(name)) + entity), 2 * len(name))  # copies in several pieces count once
    run, entity = _whole_runs(run, entity)
    if not len(run):
        return None
    here = distinct(entity >> 1)
    entity = 2 * np.searchsorted(here, entity >> 1) + (entity & 1)
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    return {"bucket": bucket, "ids": (name[here] << np.uint64(1)).tobytes(),
            "starts": starts.astype(np.int64).tobytes(), "members": entity.astype(np.int32).tobytes()}


def collect_runs(packed: DataFrame) -> DataFrame:
    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        found = _runs_of(int(key[0]), group["body"].tolist())
        return pd.DataFrame([found] if found else [], columns=[c.split()[0] for c in MET.split(", ")])
    return packed.groupBy("bucket").applyInPandas(run, MET)


def answered(runs: DataFrame, facts: DataFrame, parts: int, answer) -> DataFrame:
    """(of, told): per bucket of ``runs`` the answers to its entities (16-byte keys or 8-byte
    numbers in ``ids``).  Questions (with how many runs of the bucket hold the entity, by role) and
    ``facts`` (first column: the key) meet in packed arrays in ``parts`` parts by a key's number;
    ``answer(asked, own, low, facts, keys)`` gets a part's ids and total counts and returns the
    asked places that have an answer, and a matrix of bytes with a row for each."""
    width = 16 if "usable" in runs.columns else 8

    def part_of(ids: np.ndarray) -> np.ndarray:
        number = numbers(ids) if ids.dtype.itemsize == 16 else ids.view(np.uint64)
        return ((number >> np.uint64(1)) % np.uint64(parts)).astype(np.int32)

    def dealt(part: np.ndarray):
        order = np.argsort(part, kind="stable")
        return [x for x in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(x)]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column(1)[i].as_py(), f"V{width}")
                count = np.bincount(np.frombuffer(batch.column(2)[i].as_py(), np.int32), minlength=2 * len(ids)).astype(np.int32)
                part = part_of(ids)
                lots = dealt(part)
                bodies = [x.astype(np.int32).tobytes() + ids[x].tobytes() + count[2 * x].tobytes() + count[2 * x + 1].tobytes() for x in lots]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(part[x[0]]) for x in lots], pa.int32()), pa.array([batch.column(0)[i].as_py()] * len(lots), pa.int32()),
                     pa.array(bodies, pa.binary())], ["part", "bucket", "body"])

    def state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            part = part_of(np.frombuffer(b"".join(batch.column(0).to_pylist()), "V16"))
            lots = dealt(part)
            bodies = []
            for x in lots:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(batch.take(pa.array(x)))
                bodies.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(part[x[0]]) for x in lots], pa.int32()), pa.array([-1] * len(lots), pa.int32()),
                 pa.array(bodies, pa.binary())], ["part", "bucket", "body"])

    def meet(key, group: pd.DataFrame) -> pd.DataFrame:
        known = [pa.ipc.open_stream(body).read_all() for body in group.loc[group["bucket"] < 0, "body"]]
        group = group[group["bucket"] >= 0]
        if not known or not len(group):
            return pd.DataFrame([], columns=["of", "body"])
        known = pa.concat_tables(known)
        at, ids, own, low, ends = [], [], [], [], [0]
        for body in group["body"]:
            n = len(body) // (width + 12)
            at.append(np.frombuffer(body, np.int32, n))
            ids.append(np.frombuffer(body, f"V{width}", n, 4 * n))
            own.append(np.frombuffer(body, np.int32, n, (4 + width) * n))
            low.append(np.frombuffer(body, np.int32, n, (8 + width) * n))
            ends.append(ends[-1] + n)
        name, of = np.unique(np.concatenate(ids), return_inverse=True)
        count = [np.bincount(of, np.concatenate(x), len(name)) for x in (own, low)]
        keys = np.frombuffer(b"".join(known.column(0).to_pylist()), "V16")
        place, told = answer(name, *count, known, keys)
        at = np.concatenate(at)
        order = np.argsort(place, kind="stable")
        place, told = place[order], told[order]
        first, times = np.searchsorted(place, of), 0
        times = np.searchsorted(place, of, side="right") - first
        out = []
        for a, b, bucket in zip(ends, ends[1:], group["bucket"].tolist(), strict=False):
            k = times[a:b]
            if k.any():
                row = np.repeat(first[a:b], k) + np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
                out.append((bucket, np.repeat(at[a:b], k).tobytes() + told[row].tobytes()))
        return pd.DataFrame(out, columns=["of", "body"])

    kind = "part int, bucket int, body binary"
    messages = runs.select("bucket", "ids", "members").mapInArrow(ask, kind).unionByName(facts.mapInArrow(state, kind))
    return messages.groupBy("part").applyInPandas(meet, "of int, body binary").groupBy("of").agg(F.collect_list("body").alias("told"))


def _heard(told: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and answers (rows of ``width`` bytes) of a bucket's messages, in the order of places."""
    n = [len(x) // (4 + width) for x in told]
    at = np.concatenate([np.frombuffer(x, np.int32, k) for x, k in zip(told, n, strict=True)])
    rows = np.concatenate([np.frombuffer(x, np.uint8, offset=4 * k).reshape(k, width) for x, k in zip(told, n, strict=True)])
    order = np.lexsort((*rows.T[15::-1], at))
    return at[order], rows[order]


ENTITY = np.dtype([("key", "V16"), ("size", "<u4"), ("usable", "<u4"), ("score", "<f4"), ("own", "?"), ("low", "?")])


def hopeful(runs: DataFrame, room: DataFrame, parts: int) -> DataFrame:
    """The runs with keys for numbers, without the roles of entities that share no more signatures
    than ``slack`` (a similar set shares more).  ``room``: set_key, n_shingles, usable, slack, slack_low."""
    def judge(name, own, low, facts, keys):
        number = numbers(keys)
        name = name.view(np.uint64)
        order = np.argsort(name)
        at = np.minimum(np.searchsorted(name[order], number), len(name) - 1)
        asked = np.flatnonzero(name[order][at] == number)
        place = order[at[asked]]
        n, usable, slack, slack_low = (facts.column(c).to_numpy()[asked] for c in range(1, 5))
        out = np.zeros(len(asked), ENTITY)
        out["key"], out["size"], out["usable"] = keys[asked], n, usable
        out["score"] = own[place] / np.maximum(usable, 1)
        out["own"], out["low"] = own[place] > slack, low[place] > slack_low
        keep = out["own"] | out["low"]
        return place[keep], out[keep].view(np.uint8).reshape(-1, ENTITY.itemsize)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("bucket", "starts", "members", "told")}
                at, known = _heard(row["told"], ENTITY.itemsize)
                known = known.reshape(-1).view(ENTITY)
                member, starts = np.frombuffer(row["members"], np.int32).astype(np.int64), np.frombuffer(row["starts"], np.int64)
                run = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(member)]))
                first = np.searchsorted(at, member >> 1)
                times = np.searchsorted(at, member >> 1, side="right") - first  # more than one: sets with one number
                entity = np.repeat(first, times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                run, low = np.repeat(run, times), np.repeat(member & 1, times)
                alive = np.where(low == 1, known["low"][entity], known["own"][entity])
                run, member = _whole_runs(run[alive], (2 * entity + low)[alive])
                if not len(run):
                    continue
                here = distinct(member >> 1)
                member = 2 * np.searchsorted(here, member >> 1) + (member & 1)
                starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
                known = known[here]
                fields = (known["key"], known["size"], known["usable"], known["score"], starts.astype(np.int64), member.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([row["bucket"]], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in fields)],
                                                 [c.split()[0] for c in RUNS.split(", ")])
    told = answered(runs, room.select("set_key", "n_shingles", "usable", "slack", "slack_low"), parts, judge)
    return runs.join(told, F.col("bucket") == F.col("of")).mapInArrow(kept, RUNS)


def _open(row: dict) -> tuple[np.ndarray, ...]:
    return (np.frombuffer(row["ids"], "V16"), np.frombuffer(row["sizes"], np.uint32).astype(np.int64),
            np.frombuffer(row["usable"], np.uint32).astype(np.int64), np.frombuffer(row["starts"], np.int64), np.frombuffer(row["members"], np.int32).astype(np.int64))


def _least_shared(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, usable: np.ndarray) -> np.ndarray:
    """How many signatures two similar sets share at least: the usable segments of the
    smaller less the most differences (for one-deletion signatures this is no bound)."""
    smaller = np.where(sizes[a] <= sizes[b], a, b)
    return usable[smaller] - (sizes[a] + sizes[b]) // 7


def first_partners(runs: DataFrame) -> DataFrame:
    """(a, b): for an entity b the leading entity a of those runs that it shares most often, if
    they share enough to look similar; the lead has the largest part of its signatures in runs
    (the original among its copies).  A first guess that need not be complete."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("ids", "sizes", "usable", "scores", "starts", "members")}
                ids, sizes, usable, starts, members = _open(row)
                entity = members >> 1
                by_score = np.argsort(-np.frombuffer(row["scores"], np.float32), kind="stable")  # ids are sorted
                rank = np.argsort(by_score)
                lead = np.repeat(by_score[np.minimum.reduceat(rank[entity], starts)], np.diff(np.r_[starts, len(entity)]))
                near = (entity != lead) & (4 * np.minimum(sizes[entity], sizes[lead]) >= 3 * np.maximum(sizes[entity], sizes[lead]))
                code, shared = np.unique(entity[near] * len(ids) + lead[near], return_counts=True)
                if not len(code):
                    continue
                of, at = np.divmod(code, len(ids))
                order = np.lexsort((at, -shared, of))
                best = order[np.r_[True, np.diff(of[order]) > 0]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.tobytes() for x in ids[at[best]]], pa.binary()),
                     pa.array([x.tobytes() for x in ids[of[best]]], pa.binary()),
                     pa.array(shared[best], pa.int64()),
                     pa.array(_least_shared(at[best], of[best], sizes, usable), pa.int64())], ["a", "b", "shared", "least"])
    found = runs.mapInArrow(run, "a binary, b binary, shared long, least long").groupBy("a", "b").agg(
        F.sum("shared").alias("shared"), F.max("least").alias("least"))
    best = found.groupBy("b").agg(F.max(F.struct("shared", "a", "least")).alias("best"))
    return best.where("3 * best.shared >= best.least").select(F.col("best.a").alias("a"), "b")


def cross_pairs(group: np.ndarray, most: int = PAIR_BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of members in different groups, about ``most`` at a time; pairs
    within a group are never built."""
    order = np.argsort(group, kind="stable")
    sorted_ = group[order]
    after = np.searchsorted(sorted_, sorted_, side="right")  # where the later groups begin
    count = len(group) - after
    ends, start = np.cumsum(count), 0
    while start < len(group):
        held = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, held + most, side="right")))
        times = count[start:stop]
        i = np.repeat(np.arange(start, stop), times)
        j = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times) + after[i]
        i, j = order[i], order[j]
        yield np.minimum(i, j), np.maximum(i, j)
        start = stop


def open_pairs(runs: DataFrame, components: DataFrame, run_cost: float, level: int, parts: int) -> DataFrame:
    """All pairs of a run in different components, a no larger than b, with how many of the
    bucket's runs they share and must share at least; and what hot runs cost their members:
    rows (a, b, low, n, least), pairs with b and costs without.  Past level 0 ``usable`` is
    what a set shares with any others at most, and pairs that need more are left out."""
    lost_each = 1 + level

    def component_of(name, own, low, facts, keys):
        order = np.argsort(name)
        at = np.minimum(np.searchsorted(name[order], keys), len(name) - 1)
        asked = np.flatnonzero(name[order][at] == keys)
        component = np.frombuffer(b"".join(facts.column(1).take(pa.array(asked)).to_pylist()), np.uint8).reshape(-1, 16)
        return order[at[asked]], component

    told = answered(runs, components.select("node", "component"), parts, component_of)
    joined = runs.join(told, F.col("bucket") == F.col("of"), "left").drop("of")

    def pairs_of(row: dict, told: list[bytes] | None):
        ids, sizes, usable, starts, members = _open(row)
        group = np.arange(len(ids))
        if told:
            at, component = _heard(told, 16)
            group[at] = len(ids) + np.unique(component.reshape(-1).view("V16"), return_inverse=True)[1]
        of = group[members >> 1]
        mixed = np.flatnonzero(np.minimum.reduceat(of, starts) != np.maximum.reduceat(of, starts))
        ends = np.r_[starts[1:], len(members)]
        pairs, lost, held = [], [], 0
        for r in mixed:
            part = members[starts[r]:ends[r]]
            e = np.unique(part >> 1)
            g, s = group[e], sizes[e]
            low = np.ones(len(e), bool)
            low[np.searchsorted(e, part[part & 1 == 0] >> 1)] = False
            n, (_, each) = len(e), np.unique(g, return_counts=True)
            if (n * n - int((each.astype(np.int64) ** 2).sum())) / 2 > run_cost * n:
                lost.append(part)
                continue
            for i, j in cross_pairs(g):
                ok = (4 * np.minimum(s[i], s[j]) >= 3 * np.maximum(s[i], s[j])) & ~(low[i] & low[j])
                i, j = e[i[ok]], e[j[ok]]
                if level:
                    ok = 7 * np.minimum(usable[i], usable[j]) >= 3 * (sizes[i] + sizes[j])
                    i, j = i[ok], j[ok]
                swap = sizes[i] > sizes[j]
                pairs.append(np.where(swap, j, i) * len(ids) + np.where(swap, i, j))
                held += len(i)
                if held >= 4 * PAIR_BLOCK:  # the counts of a pair's batches are summed later
                    yield from batches_of(row, pairs, [])
                    pairs, held = [], 0
        yield from batches_of(row, pairs, lost)

    def batches_of(row: dict, pairs: list, lost: list):
        ids, sizes, usable, _, _ = _open(row)
        code, shared = np.unique(np.concatenate(pairs), return_counts=True) if pairs else (np.zeros(0, np.int64),) * 2
        for start in range(0, len(code), PAIR_ROWS):
            n = shared[start:start + PAIR_ROWS]
            a, b = np.divmod(code[start:start + PAIR_ROWS], len(ids))
            least = _least_shared(a, b, sizes, usable) if not level else np.zeros(len(a), np.int64)
            yield pa.RecordBatch.from_arrays([_keys(ids[a]), _keys(ids[b]), pa.nulls(len(a), pa.int32()), pa.array(n), pa.array(least)],
                                             ["a", "b", "low", "n", "least"])
        who, times = np.unique(np.concatenate(lost), return_counts=True) if lost else (np.zeros(0, np.int64),) * 2
        yield pa.RecordBatch.from_arrays([_keys(ids[who >> 1]), pa.nulls(len(who), pa.binary()), pa.array(who & 1, pa.int32()),
                                          pa.array(times * lost_each, pa.int64()), pa.nulls(len(who), pa.int64())], ["a", "b", "low", "n", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a bucket at a time: its arrays are large
                row = {c: batch.column(c)[i].as_py() for c in ("ids", "sizes", "usable", "starts", "members")}
                yield from pairs_of(row, batch.column("told")[i].as_py())
    return joined.mapInArrow(run, OPEN)


def word_set(text: bytes) -> frozenset:
    w = words(text)
    return frozenset(zip(*[w[i:] for i in range(WIDTH)], strict=False)) if len(w) >= WIDTH else frozenset([tuple(w)] if w else [])


def contents(docs: DataFrame, sets: DataFrame, needed: DataFrame) -> DataFrame:
    """(set_key, text) of the entities in ``needed`` (a): one document's text each (more if
    rows repeat its id).  Texts that cannot be wanted are left out before the shuffle."""
    keeper = sets.join(needed.select(F.col("a").alias("k")).distinct(), F.col("set_key") == F.col("k"), "left_semi")
    keeper = shared_table(keeper.groupBy("set_key").agg(F.min("doc_id").alias("at")), "join-keepers")
    texts, _ = parted(_texts(docs), "doc_id", keeper.select("at"))
    texts = texts.join(keeper.select("at").distinct(), F.col("doc_id").eqNullSafe(F.col("at")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, 0):
            split = [words(t) for t in part.column(0).to_pylist()]
            keys = [set_key(s) if len(s) else b"" for s in shingle_sets(split)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(map(b" ".join, split), pa.binary())],
                                             ["set_key", "text"])
    found = texts.select("text").mapInArrow(run, "set_key binary, text binary")
    return found.join(keeper.select(F.col("set_key").alias("k")), F.col("set_key") == F.col("k"), "left_semi")


def linked(pairs: DataFrame, content: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts' word shingles have 4 * intersection >= 3 * union."""
    left = content.select(F.col("set_key").alias("a"), F.col("text").alias("a_text"))
    right = content.select(F.col("set_key").alias("b"), F.col("text").alias("b_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, known = [], (None, None)
            for a, b in zip(batch.column("a_text"), batch.column("b_text"), strict=True):
                a, b = a.as_py(), b.as_py()
                if known[0] != a:  # a first entity comes with many partners
                    known = (a, word_set(a))
                other = word_set(b)
                both = len(known[1] & other)
                ok.append(100 * both >= 75 * (len(known[1]) + len(other) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))
    texts = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "a_text", "b_text")
    return texts.mapInArrow(run, "a binary, b binary").distinct()


def _keys(x: np.ndarray) -> pa.Array:
    """16-byte keys as a binary column, without an object for each."""
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, 16 * len(x) + 1, 16, dtype=np.int32)),
                                                       pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def _own(texts: DataFrame) -> DataFrame:
    """(k, own, n): how many of a set's n shingles no other of the texts' sets has, where there are
    any.  A shingle whose holders' least and largest keys agree has one holder: no join is needed,
    and a shingle of very many sets is reduced before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, 0):
            sets = [s for s in shingle_sets([words(t) for t in part.column(0).to_pylist()]) if len(s)]
            if sets:
                length = np.fromiter(map(len, sets), np.int64, len(sets))
                of = np.repeat(np.arange(len(sets)), length)
                key = np.frombuffer(b"".join(map(set_key, sets)), np.int64).reshape(-1, 2)[of]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[:, 0], key[:, 1], length[of], np.concatenate(sets).view(np.int64))],
                                                 ["x", "y", "n", "shingle"])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in range(2)], axis=1)
            yield pa.RecordBatch.from_arrays([_keys(key), batch.column(2), batch.column(3)], ["k", "own", "n"])
    held = texts.select("text").mapInArrow(run, "x long, y long, n long, shingle long").groupBy("shingle").agg(
        F.min("x").alias("x"), F.max("x").alias("x2"), F.min("y").alias("y"), F.max("y").alias("y2"), F.max("n").alias("n"))
    own = held.where("x = x2 and y = y2").groupBy("x", "y").agg(F.count(F.lit(1)).alias("own"), F.max("n").alias("n"))
    return own.mapInArrow(named, "k binary, own long, n long")


def _tokens(texts: DataFrame) -> DataFrame:
    """The entities' shingles: id, n, shingle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, 0):
            for s in shingle_sets([words(t) for t in part.column(0).to_pylist()]):
                if len(s):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([set_key(s)] * len(s), pa.binary()), pa.array([len(s)] * len(s), pa.int32()),
                         pa.array(s.view(np.int64))], ["id", "n", "shingle"])
    return texts.select("text").mapInArrow(run, "id binary, n int, shingle long").distinct()


LOTS = "lot int, ids binary, sizes binary, of binary, shingles binary, often binary"


def _lots(lot: np.ndarray, ids: np.ndarray, sizes: np.ndarray, of: np.ndarray, shingle: np.ndarray, often: np.ndarray) -> list[tuple]:
    """The shingles (of: the place of each one's set in ``ids``) packed by lot, a row a lot."""
    order = np.argsort(lot, kind="stable")
    out = []
    for x in np.split(order, np.flatnonzero(np.diff(lot[order])) + 1):
        if len(x):
            here = distinct(of[x])
            out.append((int(lot[x[0]]), ids[here].tobytes(), sizes[here].tobytes(), np.searchsorted(here, of[x]).astype(np.int32).tobytes(),
                        shingle[x].tobytes(), often[x].tobytes()))
    return out


def _unpacked(group: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """The packed rows of a lot as one: ids, sizes, of, shingles, often."""
    ids, sizes, of, shingle, often = (
        [np.frombuffer(x, kind) for x in group[c]]
        for c, kind in (("ids", "V16"), ("sizes", np.int64), ("of", np.int32), ("shingles", np.uint64), ("often", np.int32)))
    name, first, place = np.unique(np.concatenate(ids), return_index=True, return_inverse=True)
    start = np.cumsum([0, *map(len, ids)])
    of = np.concatenate([place[x + s] for x, s in zip(of, start, strict=False)])
    return name, np.concatenate(sizes)[first], of, np.concatenate(shingle), np.concatenate(often)


def _rarest(texts: DataFrame, lots: int) -> DataFrame:
    """Every entity's rarest shingles (prefix of n - ceil(3n/4) + 1) as id, n, at (the place in its
    order of rarity) and shingle.  The shingles are counted in lots by shingle and ordered in
    lots by entity, both packed in arrays."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, 0):
            known = {set_key(s): s for s in shingle_sets([words(t) for t in part.column(0).to_pylist()]) if len(s)}
            if known:
                length = np.fromiter(map(len, known.values()), np.int64, len(known))
                shingle = np.concatenate(list(known.values()))
                rows = _lots((shingle % np.uint64(lots)).astype(np.int32), np.array(list(known), "V16"), length,
                             np.repeat(np.arange(len(known)), length), shingle, np.zeros(len(shingle), np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if i else pa.int32()) for i, x in enumerate(zip(*rows, strict=True))],
                                                 [c.split()[0] for c in LOTS.split(", ")])

    def count(key, group: pd.DataFrame) -> pd.DataFrame:
        ids, sizes, of, shingle, _ = _unpacked(group)
        order = np.lexsort((of, shingle))
        of, shingle = of[order], shingle[order]
        once = np.r_[True, (of[1:] != of[:-1]) | (shingle[1:] != shingle[:-1])]  # equal sets in several rows count once
        of, shingle = of[once], shingle[once]
        starts = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]])
        held = np.diff(np.r_[starts, len(shingle)])
        lot = ((numbers(ids) >> np.uint64(1)) % np.uint64(lots)).astype(np.int32)
        return pd.DataFrame(_lots(lot[of], ids, sizes, of, shingle, np.repeat(held, held).astype(np.int32)),
                            columns=[c.split()[0] for c in LOTS.split(", ")])

    def cut(key, group: pd.DataFrame) -> pd.DataFrame:
        ids, sizes, of, shingle, often = _unpacked(group)
        order = np.lexsort((shingle, often, of))
        of, shingle = of[order], shingle[order]
        at = np.arange(len(of)) - np.searchsorted(of, of)
        kept = at <= sizes[of] // 4
        name = np.array([x.tobytes() for x in ids], object)
        return pd.DataFrame({"id": name[of[kept]], "n": sizes[of[kept]], "at": at[kept], "shingle": shingle[kept].view(np.int64)})
    packed = texts.select("text").mapInArrow(pack, LOTS)
    return packed.groupBy("lot").applyInPandas(count, LOTS).groupBy("lot").applyInPandas(cut, "id binary, n int, at int, shingle long")


def _rare_prefixes(texts: DataFrame, lots: int | None = None) -> DataFrame:
    """Last step: ``_rarest``, and how many prefixes hold the shingle (crowd, null if no more than
    RARE_BLOCK)."""
    prefix = shared_table(_rarest(texts, lots or int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "join-prefixes")
    large = prefix.groupBy("shingle").agg(F.count(F.lit(1)).alias("crowd")).where(F.col("crowd") > RARE_BLOCK)
    large = F.broadcast(large.withColumnRenamed("shingle", "of"))  # a thousandth of the prefixes at most
    return shared_table(prefix.join(large, F.col("shingle") == F.col("of"), "left").drop("of"), "join-prefixes")


def _rare_leads(prefixes: DataFrame, own: DataFrame) -> DataFrame:
    """(a, b): for an entity b the leading entity a of its prefix's shingles that it meets most
    often, the lead with the largest part of its shingles in common with others."""
    scored = prefixes.join(own.select("k", "own"), F.col("id") == F.col("k"), "left").select(
        "id", "shingle", F.struct((1 - F.coalesce("own", F.lit(0)) / F.col("n")).alias("score"), "id").alias("rank"))
    leads = scored.groupBy("shingle").agg(F.max("rank").alias("lead")).select(F.col("shingle").alias("of"), F.col("lead.id").alias("lead"))
    found = scored.join(leads, F.col("shingle") == F.col("of")).where("id <> lead").groupBy("id", "lead").agg(F.count(F.lit(1)).alias("times"))
    return found.groupBy(F.col("id").alias("b")).agg(F.max_by("lead", F.struct("times", "lead")).alias("a")).select("a", "b")


def _with_part(prefixes: DataFrame, components: DataFrame) -> DataFrame:
    return prefixes.join(components, F.col("id") == F.col("node"), "left").withColumn("part", F.coalesce("component", "id"))


def _near_pairs(n: np.ndarray, at: np.ndarray, part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Of the sets that hold a shingle, by size: each, and the larger ones of other components that
    it can be similar to if this is their first common shingle (what follows it bounds them)."""
    rest = n - at
    for k in np.flatnonzero(7 * rest >= 6 * n).tolist():
        far = slice(k + 1, int(np.searchsorted(3 * n, min(4 * n[k], 7 * rest[k] - 3 * n[k]), side="right")))
        found = k + 1 + np.flatnonzero((part[far] != part[k]) & (7 * rest[far] >= 3 * (n[far] + n[k])))
        if len(found):
            yield k, found


def _dealt_pairs(prefixes: DataFrame, components: DataFrame) -> DataFrame:
    """The open pairs (a, b) of crowded shingles.  Each pair of member blocks is a group of its own;
    the places of the shared shingle bound what two sets can share from there on."""
    crowded = prefixes.where("crowd is not null").withColumn("blocks", F.ceil(F.col("crowd") / RARE_BLOCK)).withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    dealt = _with_part(crowded, components).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "shingle", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "n", "at", "part")

    def meet(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n", "id"])  # the smaller set of a pair comes first
        ids, block = group["id"].to_numpy(), group["block"].to_numpy()
        a, b = [], []
        for k, found in _near_pairs(group["n"].to_numpy(np.int64), group["at"].to_numpy(np.int64), pd.factorize(group["part"])[0]):
            if key[1] != key[2]:  # pairs within a block are another group's
                found = found[block[found] != block[k]]
            a += [ids[k]] * len(found)
            b += ids[found].tolist()
        return pd.DataFrame({"a": a, "b": b})
    return dealt.groupBy("shingle", "i", "j").applyInPandas(meet, "a binary, b binary")


def _rare_pairs(prefixes: DataFrame, components: DataFrame, buckets: int) -> DataFrame:
    """The open pairs (a, b) of uncrowded shingles, a bucket of shingles at a time."""
    def meet(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(part=pd.factorize(group["part"])[0]).sort_values(["shingle", "n", "id"])
        ids, shingle = group["id"].to_numpy(), group["shingle"].to_numpy()
        n, at, part = (group[c].to_numpy(np.int64) for c in ("n", "at", "part"))
        cuts = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1], True]).tolist()
        pairs = set()
        for x, y in zip(cuts, cuts[1:], strict=False):
            if y - x > 1:
                for k, found in _near_pairs(n[x:y], at[x:y], part[x:y]):
                    pairs.update((ids[x + k], ids[x + i]) for i in found.tolist())
        return pd.DataFrame(list(pairs), columns=["a", "b"])
    rare = _with_part(prefixes.where("crowd is null"), components).select(
        "id", "n", "at", "shingle", "part", F.pmod("shingle", F.lit(buckets)).cast("int").alias("bucket"))
    return rare.groupBy("bucket").applyInPandas(meet, "a binary, b binary")


def links(docs: DataFrame, sets: DataFrame, run_cost: float = RUN_COST, buckets: int | None = None) -> DataFrame:
    """(entity, component) of all linked entities; ``sets``: the written ``describe`` table."""
    spark = docs.sparkSession
    shingles, entities = sets.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.count("set_key")).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, math.ceil(entities / PART_ENTITIES))
    if buckets is None:
        buckets = max(least, math.ceil(10 * shingles / BUCKET_BYTES))
    texts, edges, groups = _texts(docs), None, None
    room = sets.where("set_key is not null").select(
        "set_key", "n_shingles", (F.col("slack") + F.floor(F.col("n_shingles") / 3) + 1).cast("int").alias("usable"), "slack", "slack_low").distinct()
    for level in range(2):
        met = shared_table(collect_runs(pack(texts, level, buckets)), "join-met")
        # one-deletion signatures give no bound by their number
        hope = room if not level else room.withColumns({"slack": F.lit(-1), "slack_low": F.lit(-1)})
        runs = shared_table(hopeful(met, hope, parts), "join-runs")
        if not level:
            tried = shared_table(first_partners(runs), "join-tried")
            edges = shared_table(linked(tried, _contents_of(docs, sets, tried)), "join-linked")
            groups = known = _grouped(edges)
        rest = shared_table(open_pairs(runs, known, run_cost, level, parts), "join-open")
        lost = rest.where("b is null").groupBy("a").agg(
            F.coalesce(F.sum(F.when(F.col("low") == 0, F.col("n"))), F.lit(0)).alias("lost"),
            F.coalesce(F.sum(F.when(F.col("low") == 1, F.col("n"))), F.lit(0)).alias("lost_low"))
        hot = shared_table(lost.join(room, F.col("set_key") == F.col("a")).select(
            F.col("a").alias("k"), "lost", "lost_low", F.expr("slack < lost or slack_low < lost_low").alias("open")), "join-hot")
        unsettled = hot.where("open").select(F.col("k").alias("a"))
        pairs = rest.where("b is not null").groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("least").alias("least"))
        pairs = shared_table(_to_compare(pairs, hot), "join-pairs")
        if not pairs.isEmpty():
            edges, groups = _more(edges, groups, linked(pairs, _contents_of(docs, sets, pairs)))
        if unsettled.isEmpty():
            break
        texts = shared_table(contents(docs, sets, unsettled), "join-unsettled-texts")
        own = shared_table(_own(texts), "join-own")
        # a similar set has three quarters of a set's shingles
        texts = shared_table(texts.join(own.where("4 * own > n"), F.col("set_key") == F.col("k"), "left_anti"), "join-unsettled-texts")
        if texts.isEmpty():
            break
        if not level:
            room = shared_table(_room(texts).join(own.select("k", "own"), F.col("set_key") == F.col("k"), "left").select(
                "set_key", "n_shingles", (F.col("n_shingles") - F.coalesce("own", F.lit(0))).cast("int").alias("usable"), "slack", "slack_low"), "join-room")
    else:
        prefixes = _rare_prefixes(texts, buckets)
        edges, groups = _more(edges, groups, linked(_rare_leads(prefixes, own), texts))
        groups = groups or _grouped(edges)
        pairs = _dealt_pairs(prefixes, groups).unionByName(_rare_pairs(prefixes, groups, buckets)).distinct()
        edges, groups = _more(edges, groups, linked(shared_table(pairs, "join-pairs"), texts))
    return groups or _grouped(edges)


def _grouped(edges: DataFrame) -> DataFrame:
    return shared_table(connected(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))), "join-parts")


def _more(edges: DataFrame, groups: DataFrame | None, found: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The links with those found; the components, or None if there are new ones to find."""
    found = shared_table(found, "join-linked")
    return (edges, groups) if found.isEmpty() else (edges.unionByName(found), None)


def _to_compare(pairs: DataFrame, hot: DataFrame) -> DataFrame:
    """The pairs (a, b) that may share enough signatures, hot runs included, and of which one at
    least is settled: the next step meets the others.  ``hot``: k, lost, lost_low, open."""
    of_a = hot.select(F.col("k").alias("__a"), F.col("lost").alias("lost_a"), F.col("open").alias("open_a"))
    of_b = hot.select(F.col("k").alias("__b"), (F.col("lost") + F.col("lost_low")).alias("lost_b"), F.col("open").alias("open_b"))
    pairs = pairs.join(of_a, F.col("a") == F.col("__a"), "left").where("n + coalesce(lost_a, 0) >= least").drop("__a")
    pairs = pairs.join(of_b, F.col("b") == F.col("__b"), "left").where("n + if(lost_a is null or lost_b is null, 0, least(lost_a, lost_b)) >= least")
    return pairs.where("not (coalesce(open_a, false) and coalesce(open_b, false))").select("a", "b")


def _contents_of(docs: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    ends = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a")))
    return shared_table(contents(docs, sets, ends), "join-texts")


def _room(texts: DataFrame) -> DataFrame:
    """The level-1 room (capacity beyond the need) of texts, as in ``describe``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, 0):
            sets = [s for s in shingle_sets([words(t) for t in part.column(0).to_pylist()]) if len(s)]
            own, low = rooms(sets, 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_key(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(own, pa.int32()), pa.array(low, pa.int32())], ["set_key", "n_shingles", "slack", "slack_low"])
    return texts.select("text").mapInArrow(run, "set_key binary, n_shingles long, slack int, slack_low int").distinct()


def jaccard_join(docs: DataFrame, run_cost: float = RUN_COST, buckets: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id."""
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        sets = shared_table(describe(docs), "join-sets")
        parts = links(docs, sets, run_cost, buckets)
    rep = sets.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("least"))
    placed = rep.join(parts, F.col("set_key") == F.col("node"), "left").withColumn(
        "part", F.coalesce("component", "set_key"))
    smallest = placed.groupBy("part").agg(F.min("least").alias("component_id")).withColumnRenamed("part", "p")
    ids = shared_table(placed.join(smallest, F.col("part") == F.col("p")).select(
        F.col("set_key").alias("k"), "component_id"), "join-components")
    out = sets.join(ids, F.col("set_key") == F.col("k"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component (the one with its smallest id),
    all columns kept; rows without words and rows without an id stay."""
    gone = shared_table(jaccard_join(docs).where("component_id <> doc_id").select(F.col("doc_id").alias("__gone"))
                        .distinct(), "join-gone")
    doubtful, stay = parted(docs.withColumn("__id", F.col("doc_id").cast("long")), "__id", gone)
    kept = doubtful.join(gone, F.col("__id") == F.col("__gone"), "left_anti")
    return stay.unionByName(kept).select(*docs.columns)
