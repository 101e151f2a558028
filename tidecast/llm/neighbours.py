"""Approximate nearest neighbours: NN-descent graph, greedy graph search.

Equal vectors are one node of the graph (up to a hundred copies can share an
answer's places, so a node keeps its smallest vec_ids; which of them an answer
takes is decided exactly).  The first graph joins nodes that lie next to each
other along random projections: each projection sorts the nodes by range
partitioning, and blocks of the sorted run are compared exactly.  NN-descent
then joins neighbours of neighbours: every node sends itself, forward and
backward, to its neighbours, a node's visitors are compared with one another,
and the nearest of old and new are kept, until few lists still change.  How
many visitors meet at one node and one pass is bounded; a hub's further
visitors meet in further groups of the same pass, drawn by a hash, so none is
left out.

Queries walk the graph: from its own node, the nodes beside it along the sorted
projections and the nearest of a bounded set of entry nodes a beam of best nodes
is expanded, all queries at once by joins on the graph, until no query's beam
holds a node that was not expanded.  The entry nodes only shorten the walk: a
query's own node reaches its neighbours in any table.  Distances are Euclidean in
double precision on the original vectors; the graph is built on single-precision vectors.

Defined results: vectors that are null, all zero or hold a null or non-finite
component take no part, neither as queries nor as candidates; a vec_id that is
null takes none either; rows that repeat vec_id and vector are one candidate;
with fewer candidates than places all are returned; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_table

K = 20               # neighbours of a node in the graph
PROJECTIONS = 4      # sorted runs of the first graph
BLOCK = 512          # nodes of a sorted run that are compared with one another
VISITORS = 64        # nodes that meet in one group of a pass
SETTLED = 0.02       # NN-descent ends when no more than this share of the links changes in a pass
SIDE = 4             # nodes on each side along a projection from which a query starts
ENTRIES = 512        # entry nodes (twice as many at most): bounded, so they are sent to every task
BEAM = 512
EXPAND = 96          # beam nodes a query expands in a step
COPIES = 16          # smallest vec_ids that a node keeps for an answer of up to COPIES - 1 places


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and the vector as doubles, of the rows that take part."""
    vector = F.col("embedding").cast("array<double>")
    fine = (F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
            & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(vector, lambda x: x != 0))
    # adding zero makes -0.0 and 0.0 one value, as they are one place
    return rows.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"),
                                   F.transform(vector, lambda x: x + F.lit(0.0)).alias("vector"))


def nodes(vectors: DataFrame, copies: int = COPIES) -> DataFrame:
    """One row per distinct vector: node (its smallest vec_id), vector, and vec_ids, its
    smallest ``copies`` ids.  Large groups of copies are cut per salt before they meet."""
    distinct = vectors.distinct()
    salted = distinct.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    first = Window.partitionBy("vector", "salt").orderBy("vec_id")
    few = salted.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= copies)
    again = Window.partitionBy("vector").orderBy("vec_id")
    few = few.withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= copies)
    return few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("vec_ids")).select(
        F.col("vec_ids")[0].alias("node"), "vector", "vec_ids")


def _nearest_lists(ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, neighbour, distance) of each row's k nearest among the rows."""
    n = len(ids)
    if n < 2:
        return ids[:0], ids[:0], np.zeros(0)
    vectors = vectors.astype(float)  # the differences below would drown single precision in tight clusters
    square = (vectors ** 2).sum(1)
    far = square[:, None] + square[None, :] - 2 * (vectors @ vectors.T)
    np.fill_diagonal(far, np.inf)
    k = min(k, n - 1)
    at = np.argpartition(far, k - 1, axis=1)[:, :k]
    rows = np.repeat(np.arange(n), k)
    at = at.ravel()
    return ids[rows], ids[at], np.sqrt(np.maximum(far[rows, at], 0)).astype(float)


def _beside(ids: np.ndarray, vectors: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, neighbour, distance) of the asked rows and the SIDE rows before and after each."""
    shift = np.r_[-SIDE:0, 1:SIDE + 1]
    at = np.repeat(np.flatnonzero(asked), len(shift))
    other = at + np.tile(shift, int(asked.sum()))
    inside = (other >= 0) & (other < len(ids))
    at, other = at[inside], other[inside]
    return ids[at], ids[other], np.sqrt(((vectors[at].astype(float) - vectors[other]) ** 2).sum(1))


LINKS = "node long, neighbour long, distance double"


def _links_batch(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]],
                 beside: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    node, neighbour, distance = (np.concatenate(x) for x in zip(*found, beside, strict=True))
    start = np.arange(len(node)) >= len(node) - len(beside[0])
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(neighbour, pa.int64()), pa.array(distance),
                                       pa.array(start)], ["node", "neighbour", "distance", "start"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _keep_nearest(links: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("node").orderBy("distance", "neighbour")
    links = links.groupBy("node", "neighbour").agg(F.min("distance").alias("distance"), F.max("start").alias("start"))
    return links.withColumn("rank", F.row_number().over(best)).where((F.col("rank") <= k) | F.col("start"))


def first_graph(points: DataFrame, dimension: int, k: int, projections: int, seed: int) -> DataFrame:
    """Links of the nodes (node, vector, asked) to their nearest in the sorted runs; those
    of rank above ``k`` only lead an asked node to the ones beside it (start)."""
    rng = np.random.default_rng(seed)
    parts = None
    for _ in range(projections):
        direction = rng.normal(size=dimension).tolist()
        along = F.aggregate(F.zip_with("vector", F.array(*[F.lit(x) for x in direction]), lambda a, b: a * b),
                            F.lit(0.0), lambda s, x: s + x)
        run = points.select("node", "vector", "asked", along.alias("along")).repartitionByRange("along").sortWithinPartitions("along")

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tail = None  # blocks overlap by half, so that no pair is cut at a border
            for batch in batches:
                part = batch.column(0).to_numpy(), _matrix(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
                if tail is not None:
                    part = tuple(np.concatenate(x) for x in zip(tail, part, strict=True))
                ids, vectors, asked = part
                found = [_nearest_lists(ids[i:i + BLOCK], vectors[i:i + BLOCK], k)
                         for i in range(0, max(1, len(ids) - BLOCK // 2), BLOCK // 2)]
                yield _links_batch(found, _beside(ids, vectors, asked))
                tail = tuple(x[-(BLOCK // 2):] for x in part)
        found = run.select("node", "vector", "asked").mapInArrow(blocks, LINKS + ", start boolean")
        parts = found if parts is None else parts.unionByName(found)
    return _keep_nearest(parts, k).withColumn("fresh", F.lit(True))


def packed(points: DataFrame) -> DataFrame:
    """node and its vector's single-precision numbers as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _cut(batch.column(1).flatten(), batch.column(1).offsets)],
                                             ["node", "body"])
    return points.select("node", "vector").mapInArrow(run, "node long, body binary")


def _cut(numbers: pa.Array, offsets: pa.Array) -> pa.Array:
    at = (offsets.to_numpy() - offsets[0].as_py()) * 4
    body = numbers.to_numpy(zero_copy_only=False).astype(np.float32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(body)])


def _meetings(k: int):
    """Guests sorted by (at, part) -> for every guest its ``k`` nearest of its group that are nearer
    than its worst neighbour, of pairs with a fresh guest."""
    def pairs(who: np.ndarray, fresh: np.ndarray, worst: np.ndarray, vectors: np.ndarray):
        vectors = vectors.astype(float)  # the differences below would drown single precision in tight clusters
        square = (vectors ** 2).sum(1)
        far = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * (vectors @ vectors.T), 0))
        better = (far < worst[:, None]) & (fresh[:, None] | fresh[None, :])
        np.fill_diagonal(better, False)
        far[~better] = np.inf
        if len(who) > k:  # a list has k places: a guest's k nearest of each group hold all that can enter it
            far[far > np.partition(far, k - 1, axis=1)[:, k - 1:k]] = np.inf
        a, b = np.nonzero(far < np.inf)
        return who[a], who[b], far[a, b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None  # the last group of a batch may go on in the next one
        for batch in chain(batches, [None]):
            rows = tail
            if batch is not None and batch.num_rows:
                body = b"".join(batch.column(5).to_pylist())
                rows = (*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)),
                        np.frombuffer(body, np.float32).reshape(batch.num_rows, -1))
                if tail is not None:
                    rows = tuple(np.concatenate(x) for x in zip(tail, rows, strict=True))
            if rows is None:
                continue
            at, part, who, fresh, worst, vectors = rows
            cuts = np.r_[0, np.flatnonzero((np.diff(at) != 0) | (np.diff(part) != 0)) + 1, len(at)]
            if batch is not None:
                tail = tuple(x[cuts[-2]:] for x in rows)
                cuts = cuts[:-1]
            found = [pairs(who[a:b], fresh[a:b], worst[a:b], vectors[a:b]) for a, b in zip(cuts.tolist(), cuts[1:].tolist())
                     if b - a > 1 and fresh[a:b].any()]
            if found:
                node, neighbour, distance = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(neighbour, pa.int64()),
                                                  pa.array(distance)], ["node", "neighbour", "distance"])
    return run


def descent_pass(graph: DataFrame, points: DataFrame, k: int, visitors: int, turn: int) -> DataFrame:
    """One pass: neighbours of neighbours join, at least one of a pair over a fresh link."""
    forward = graph.select(F.col("node").alias("at"), F.col("neighbour").alias("who"), "fresh")
    backward = graph.select(F.col("neighbour").alias("at"), F.col("node").alias("who"), "fresh")
    visits = forward.unionByName(backward).groupBy("at", "who").agg(F.max("fresh").alias("fresh"))
    # a hub's visitors are dealt to groups; the deal differs from pass to pass
    crowd = visits.groupBy("at").agg(F.count(F.lit(1)).alias("crowd")).withColumnRenamed("at", "hub")
    dealt = visits.join(crowd, F.col("at") == F.col("hub")).withColumn(
        "part", F.pmod(F.xxhash64(F.lit(turn), "who"), F.ceil(F.col("crowd") / visitors)))
    worst = graph.groupBy("node").agg(F.max("distance").alias("worst"), F.count(F.lit(1)).alias("n")).select(
        F.col("node").alias("w"), F.when(F.col("n") < k, float("inf")).otherwise(F.col("worst")).alias("worst"))
    # a group in which nobody came over a fresh link has met before
    met = dealt.where("fresh").select(F.col("at").alias("a"), F.col("part").alias("p")).distinct()
    dealt = dealt.join(met, (F.col("at") == F.col("a")) & (F.col("part") == F.col("p")), "left_semi")
    known = points.join(worst, F.col("node") == F.col("w"), "left").select("node", "body", F.coalesce(
        "worst", F.lit(float("inf"))).alias("worst"))
    guests = dealt.join(known, F.col("who") == F.col("node")).select("at", "part", "who", "fresh", "worst", "body")
    found = guests.repartition("at", "part").sortWithinPartitions("at", "part").mapInArrow(_meetings(k), LINKS)
    merged = graph.select("node", "neighbour", "distance", F.lit(False).alias("fresh")).unionByName(
        found.withColumn("fresh", F.lit(True)))
    merged = merged.groupBy("node", "neighbour").agg(F.min("distance").alias("distance"), F.min("fresh").alias("fresh"))
    best = Window.partitionBy("node").orderBy("distance", "neighbour")
    return merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def build_graph(points: DataFrame, k: int = K, passes: int | None = None, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """node, neighbour, distance: each node's approximate k nearest, joined until they settle
    (or for ``passes`` passes); and node, neighbour: where asked nodes start besides."""
    first = points.select(F.size("vector").alias("d")).first()
    found = shared_table(first_graph(points, first["d"] if first else 1, k, PROJECTIONS, seed), "graph")
    beside = found.where("start").select("node", "neighbour")
    graph, points, turn = found.where(F.col("rank") <= k).drop("start"), shared_table(packed(points), "packed"), 0
    while passes is None or turn < passes:  # distances only fall, so the lists settle
        graph = shared_table(descent_pass(graph, points, k, VISITORS, turn), "graph")
        changed, links = graph.agg(F.sum(F.col("fresh").cast("long")), F.count(F.lit(1))).first()
        if not links or changed <= SETTLED * links:
            break
        turn += 1
    return graph, beside


def search(queries: DataFrame, points: DataFrame, graph: DataFrame, starts: DataFrame, beam: int = BEAM,
           entries: int = ENTRIES) -> DataFrame:
    """queries (query_id, vector), each with nodes in starts (query_id, node) besides the entry
    nodes -> query_id, node, distance: each query's beam of nearest nodes."""
    share = 1.3 * entries / max(1, points.count())
    drawn = F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < int(1e6 * share) + 1
    chosen = points.where(drawn).limit(2 * entries).select("node", "vector").collect()  # at most 2 * ENTRIES rows
    if not chosen:
        chosen = points.limit(entries).select("node", "vector").collect()
    entry_ids = np.array([r["node"] for r in chosen], np.int64)
    entry = np.array([r["vector"] for r in chosen], float)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(entry_ids):
                continue
            asked = _matrix(batch.column(1))
            k = min(EXPAND, len(entry_ids))
            far = np.stack([np.sqrt(((entry - q) ** 2).sum(1)) for q in asked])
            at = np.argpartition(far, k - 1, axis=1)[:, :k]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0).to_numpy(), k), pa.int64()), pa.array(entry_ids[at.ravel()]),
                 pa.array(np.take_along_axis(far, at, 1).ravel())], ["query_id", "node", "distance"])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        # of a node met again the row that says it was expanded stays
        group = group.sort_values(["distance", "node", "expanded"], ascending=[True, True, False], kind="stable")
        group = group.drop_duplicates("node").head(beam)
        left = ~group["expanded"].to_numpy(bool)
        todo = left & (np.cumsum(left) <= EXPAND)
        return group.assign(expanded=~left | todo, todo=todo)

    rows = "query_id long, node long, distance double, expanded boolean, todo boolean"
    asked = queries.select(F.col("query_id").alias("q"), F.col("vector").alias("asked"))
    there = points.select(F.col("node").alias("n"), "vector")
    apart = F.sqrt(F.aggregate(F.zip_with("asked", "vector", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))

    def met(reached: DataFrame) -> DataFrame:
        return (reached.join(there, F.col("node") == F.col("n")).join(asked, F.col("query_id") == F.col("q"))
                .select("query_id", "node", apart.alias("distance"), F.lit(False).alias("expanded"), F.lit(False).alias("todo")))

    first = queries.select("query_id", "vector").mapInArrow(start, "query_id long, node long, distance double")
    walk = first.withColumn("expanded", F.lit(False)).withColumn("todo", F.lit(False)).unionByName(met(starts))
    walk = shared_table(walk.groupBy("query_id").applyInPandas(lambda g: merge(g), rows), "walk")
    out = graph.select(F.col("node").alias("from"), F.col("neighbour").alias("to"))
    links = shared_table(out.unionByName(out.select(F.col("to").alias("from"), F.col("from").alias("to"))).distinct(),
                         "walk-links")
    while True:  # a node is expanded once and beams only draw nearer, so the walk ends
        todo = walk.where("todo").select("query_id", "node")
        if todo.isEmpty():
            break
        reached = todo.join(links, F.col("node") == F.col("from")).select("query_id", F.col("to").alias("node")).distinct()
        walk = shared_table(walk.unionByName(met(reached)).groupBy("query_id").applyInPandas(lambda g: merge(g), rows), "walk")
    return walk.select("query_id", "node", "distance")


def nearest(rows: DataFrame, is_query, places: int = 10, graph_k: int = K, passes: int | None = None,
            entries: int = ENTRIES) -> DataFrame:
    """For every row of ``rows`` (vec_id, embedding) that the column ``is_query`` marks its
    ``places`` nearest others: query_id, rank, vec_id, score."""
    vectors = shared_table(usable(rows), "vectors")
    points = shared_table(nodes(vectors, max(COPIES, places + 1)), "nodes")
    queries = vectors.where(is_query).select(F.col("vec_id").alias("query_id"), "vector").distinct()
    # by a hash of the vector: one more node for a query, if hashes clash, is only one more start
    place = queries.select("query_id", F.xxhash64("vector").alias("place"))
    own = shared_table(points.select("node", F.xxhash64("vector").alias("at")).join(place, F.col("at") == F.col("place"))
                       .select("query_id", "node"), "own-nodes")
    marked = own.select(F.col("node").alias("of")).distinct().withColumn("asked", F.lit(True))
    single = points.join(marked, F.col("node") == F.col("of"), "left").select(
        "node", F.col("vector").cast("array<float>").alias("vector"), F.coalesce("asked", F.lit(False)).alias("asked"))
    graph, beside = build_graph(single, graph_k, passes)
    starts = own.unionByName(own.join(beside, "node").select("query_id", F.col("neighbour").alias("node"))).distinct()
    found = search(queries, points.select("node", "vector"), graph, starts, entries=entries)
    answer = (found.join(points.select(F.col("node").alias("n"), F.explode("vec_ids").alias("vec_id")), F.col("node") == F.col("n"))
              .where("vec_id <> query_id"))
    best = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return (answer.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= places)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("distance").alias("score")))
