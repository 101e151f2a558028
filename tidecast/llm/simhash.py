"""SimHash near-duplicates by a self-join of the binary trie of the fingerprints.

A fingerprint bit is 1 if it is set in more than half of the XXH64 hashes of a text's word
triples, repeats included.  The distinct fingerprints are the leaves of a binary trie.
The self-join walks pairs of trie nodes from the pair (root, root): a pair's
differing bits so far are known, a pair beyond the budget is pruned with all that hangs
below it, and any other goes on with the pairs of its children.  The upper part of the walk is joins
of a pair table with a child table, two bits a step, down to nodes with at most LEAF
fingerprints; the lower part runs inside tasks, one pair of such nodes a row, level by level
over sorted arrays.  A node meets at most those within the budget of it, and a
fingerprint has at most 2,081 others within two bits, so nothing grows with the square of
a group: copies are one fingerprint.

Defined results: a null or empty text, or one of white space, has fingerprint zero and
is linked like any other; fewer than three words are one shingle; a null doc_id is no
component_id unless all ids of the component are null; rows that repeat an id are rows of
their own; an empty table gives an empty result; other columns are ignored; texts of any
length are read whole, a stretch of shingles at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, shared_table
from .components import connected
from .skew import look_up

WIDTH = 3            # words a shingle
SEED = 42
BUDGET = 2           # differing bits of linked fingerprints
BITS = 64
LEAF = 8192          # fingerprints below a node that is walked inside a task
STEP = 2             # bits a step of the upper walk
FIRST = 16           # bits of the first histogram (at most 65,536 rows)
STRETCH = 1 << 16    # shingles hashed at once
FEW = 32             # pairs of leaves that are compared without a further split


# --- fingerprints ---------------------------------------------------------------------------

def _stretches(text: bytes) -> Iterator[list[int]]:
    """The hashes of a text's shingles, so many at once."""
    words = text.lower().split()
    if not words:
        return
    width = min(WIDTH, len(words))
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(words) - width + 1, STRETCH):
        first = starts[i:i + STRETCH][:len(words) - width + 1 - i].tolist()
        yield [digest(line[a:b], SEED) for a, b in zip(first, ends[i + width - 1:i + width - 1 + len(first)].tolist(), strict=True)]


def fingerprints_of(texts: list[bytes]) -> np.ndarray:
    """One unsigned 64-bit fingerprint a text."""
    ones, many = np.zeros((len(texts), BITS), np.int64), np.zeros(len(texts), np.int64)
    hashes: list[int] = []
    owners: list[int] = []
    begins: list[int] = []

    def settle() -> None:
        if hashes:
            bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            np.add.at(ones, owners, np.add.reduceat(bits, begins, axis=0, dtype=np.int64))
            hashes.clear(), owners.clear(), begins.clear()

    for i, text in enumerate(texts):
        for found in _stretches(text):
            owners.append(i)
            begins.append(len(hashes))
            hashes.extend(found)
            many[i] += len(found)
            if len(hashes) >= STRETCH:
                settle()
    settle()
    return np.packbits(2 * ones > many[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
        prints = fingerprints_of(texts) if texts else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, print (the fingerprint's 64 bits as a signed long): one row a row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with arrow_rows(docs.sparkSession, 512):
        return shared_table(rows.mapInArrow(_fingerprint_batches, "doc_id long, print long"), "simhash-prints")


# --- the trie's upper nodes -------------------------------------------------------------------

def top_bits(bits: Column | int, of: Column | None = None) -> Column:
    """The first so many bits of a fingerprint as a number (a whole one keeps its sign)."""
    of = F.col("print") if of is None else of
    bits = F.lit(bits) if isinstance(bits, int) else bits
    return F.when(bits == 0, 0).otherwise(F.call_function("shiftrightunsigned", of, F.least(F.lit(BITS) - bits, F.lit(BITS - 1))))


def trie(prints: DataFrame, leaf: int, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
    """(nodes, leaves) of distinct fingerprints: the nodes' depth, prefix and n (fingerprints
    below), and each fingerprint's node of at most ``leaf``: depth, prefix, print."""
    counted = prints.groupBy(top_bits(first).alias("head")).agg(F.count(F.lit(1)).alias("n"))
    depths = F.explode(F.array(*[F.lit(d) for d in range(0, first + 1, STEP)]))
    above = shared_table(counted.select("head", "n", depths.alias("depth")).withColumn(
        "prefix", F.call_function("shiftrightunsigned", "head", F.lit(first) - F.col("depth"))), "simhash-heads")
    nodes = above.groupBy("depth", "prefix").agg(F.sum("n").alias("n"))
    small = nodes.where(F.col("n") <= leaf).select("depth", "prefix")
    homes = above.join(small, ["depth", "prefix"]).groupBy("head").agg(F.min("depth").alias("depth"))
    # a head a row: at most 2^first rows, whatever the table's size
    housed = shared_table(prints.select("print", top_bits(first).alias("head")).join(F.broadcast(homes), "head", "left"), "simhash-housed")
    leaves = housed.where(F.col("depth").isNotNull()).select("depth", top_bits(F.col("depth")).alias("prefix"), "print")
    open_ = housed.where(F.col("depth").isNull()).select("print")
    for depth in range(first + STEP, BITS + 1, STEP):
        if open_.isEmpty():
            break
        at = open_.select("print", F.lit(depth).alias("depth"), top_bits(depth).alias("prefix"))
        here = shared_table(at.groupBy("depth", "prefix").agg(F.count(F.lit(1)).alias("n")), "simhash-nodes")
        nodes = nodes.unionByName(here)
        known = shared_table(look_up(at, here, ["depth", "prefix"]), "simhash-open")
        leaves = leaves.unionByName(known.where(F.col("n") <= leaf).select("depth", "prefix", "print"))
        open_ = known.where(F.col("n") > leaf).select("print")
    return shared_table(nodes, "simhash-nodes"), leaves


def node_pairs(nodes: DataFrame, leaf: int, budget: int) -> DataFrame:
    """The upper walk: pairs of leaves (du, u, dv, v) whose known bits differ in at most
    ``budget`` places."""
    inner = nodes.where(F.col("n") > leaf).select("depth", "prefix")
    depths = sorted(r[0] for r in inner.select("depth").distinct().collect())  # at most 32 numbers
    root = nodes.where(F.col("depth") == 0).select(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"))
    pairs = root.select(F.col("depth").alias("du"), F.col("prefix").alias("u"), F.col("depth").alias("dv"), F.col("prefix").alias("v"))
    for depth in depths:
        kids = nodes.where(F.col("depth") == depth + STEP).select(
            F.col("prefix").alias("kid"), F.shiftrightunsigned("prefix", STEP).alias("of")).join(
            inner.where(F.col("depth") == depth).select(F.col("prefix").alias("of")), "of")
        twin = (F.col("du") == F.col("dv")) & (F.col("u") == F.col("v"))
        now = pairs.withColumn("twin", twin)
        for d, x in (("du", "u"), ("dv", "v")):
            step = kids.select(F.lit(depth).alias(d), F.col("of").alias(x), "kid")
            now = now.join(step, [d, x], "left").withColumns(
                {x: F.coalesce("kid", x), d: F.when(F.col("kid").isNull(), F.col(d)).otherwise(F.lit(depth + STEP))}).drop("kid")
        shared = F.least("du", "dv")
        apart = F.bit_count(F.call_function("shiftrightunsigned", "u", F.col("du") - shared).bitwiseXOR(
            F.call_function("shiftrightunsigned", "v", F.col("dv") - shared)))
        now = now.where((apart <= budget) & (~F.col("twin") | (F.col("u") <= F.col("v"))))
        pairs = shared_table(now.select("du", "u", "dv", "v"), "simhash-pairs")
    return pairs


# --- the lower walk -----------------------------------------------------------------------------

def close_pairs(a: np.ndarray, b: np.ndarray, twin: bool, depth: int, apart: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """All (x, y) of two sorted arrays (x < y of one, for a twin) within the budget.  The arrays
    hold one trie node each at ``depth``; ``apart`` of their first bits differ."""
    if not len(a) or not len(b):
        return a[:0], b[:0]
    alo, ahi, blo, bhi, diff = (np.array([x]) for x in (0, len(a), 0, len(b), apart))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for d in range(depth, BITS + 1):
        few = ((ahi - alo) * (bhi - blo) <= FEW) | (d == BITS)
        if few.any():  # leaves, or nearly: compare what is left
            n, m = (ahi - alo)[few], (bhi - blo)[few]
            size = n * m
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            x = a[np.repeat(alo[few], size) + at // np.repeat(m, size)]
            y = b[np.repeat(blo[few], size) + at % np.repeat(m, size)]
            near = np.bitwise_count(x ^ y) <= budget
            if twin:
                near &= x < y
            found.append((x[near], y[near]))
            alo, ahi, blo, bhi, diff = (z[~few] for z in (alo, ahi, blo, bhi, diff))
        if not len(alo):
            break
        bit = np.uint64(1) << np.uint64(BITS - 1 - d)
        head = ~((bit << np.uint64(1)) - np.uint64(1)) if d else np.uint64(0)
        amid, bmid = np.searchsorted(a, (a[alo] & head) | bit), np.searchsorted(b, (b[blo] & head) | bit)
        same = (alo == blo) & (ahi == bhi) if twin else np.zeros(len(alo), bool)
        kids = []
        for left, right in ((0, 0), (1, 1), (0, 1), (1, 0)):
            go = ~same if (left, right) == (1, 0) else np.ones(len(alo), bool)  # a node with itself: once
            kid = (amid if left else alo, ahi if left else amid, bmid if right else blo, bhi if right else bmid, diff + (left != right))
            go = go & (kid[0] < kid[1]) & (kid[2] < kid[3]) & (kid[4] <= budget)
            kids.append([z[go] for z in kid])
        alo, ahi, blo, bhi, diff = (np.concatenate(z) for z in zip(*kids, strict=True))
    if not found:
        return a[:0], b[:0]
    return tuple(np.concatenate(z) for z in zip(*found, strict=True))


def _walk(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    for batch in batches:
        for row in zip(*[batch.column(i) for i in range(batch.num_columns)], strict=True):
            du, u, dv, v = (x.as_py() for x in row[:4])
            a, b = (np.sort(x.values.to_numpy().view(np.uint64)) for x in row[4:])
            depth = min(du, dv)
            apart = ((u % (1 << 64) >> (du - depth)) ^ (v % (1 << 64) >> (dv - depth))).bit_count()
            x, y = close_pairs(a, b, (du, u) == (dv, v), depth, apart, budget)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], schema=schema)


def links(prints: DataFrame, leaf: int = LEAF, budget: int = BUDGET, first: int = FIRST) -> DataFrame:
    """Distinct fingerprints (print) -> the pairs (u, v) within the budget, each once."""
    nodes, leaves = trie(prints, leaf, first)
    pairs = node_pairs(nodes, leaf, budget)
    packs = shared_table(leaves.groupBy("depth", "prefix").agg(F.collect_list("print").alias("prints")), "simhash-packs")  # at most ``leaf`` each
    left = packs.select(F.col("depth").alias("du"), F.col("prefix").alias("u"), F.col("prints").alias("a"))
    right = packs.select(F.col("depth").alias("dv"), F.col("prefix").alias("v"), F.col("prints").alias("b"))
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = pairs.repartition(tasks, "du", "u", "dv", "v").join(left, ["du", "u"]).join(right, ["dv", "v"]).select("du", "u", "dv", "v", "a", "b")
    with arrow_rows(prints.sparkSession, 16):
        return shared_table(both.mapInArrow(lambda x: _walk(x, budget), "u long, v long"), "simhash-links")


def near_copies(docs: DataFrame, leaf: int = LEAF, budget: int = BUDGET, first: int = FIRST) -> DataFrame:
    """One row per row: doc_id, fingerprint (16 hex digits), component_id."""
    rows = fingerprints(docs)
    known = shared_table(rows.groupBy("print").agg(F.min("doc_id").alias("low")), "simhash-known")
    found = shared_table(connected(links(known.select("print"), leaf, budget, first)), "simhash-components")
    member = known.join(found, known["print"] == found["node"]).select("print", "low", "component")
    lowest = shared_table(member.groupBy("component").agg(F.min("low").alias("component_id")), "simhash-lowest")
    linked = look_up(member.select("print", "component"), lowest, ["component"]).select("print", "component_id")
    alone = known.join(found, known["print"] == found["node"], "left_anti").select("print", F.col("low").alias("component_id"))
    whole = shared_table(linked.unionByName(alone), "simhash-all")
    return look_up(rows, whole, ["print"]).select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
