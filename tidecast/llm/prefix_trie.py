"""Conversation prefix trie: a z-fast trie over hashed turns, built in batches of joins.

Every conversation becomes a string of turns.  Strings are cut into blocks of
``block`` turns; the blocks that start after one same prefix form one compacted
trie below it, so no row holds more than ``block`` turns however long a
conversation is, and a block's last node is the root of the next blocks.  A prefix
is known by its length and 128 bits, the exclusive or of two hashes of each turn
(position, role and SHA-256 of the text): equal prefixes agree, and unequal ones
are told apart but for a chance of about 2^-128 a pair.

A compacted node stands for the prefixes of lengths (p, e].  Its handle is the prefix
whose length in (p, e] is the two-fattest (divisible by the highest power of two); a
table maps handles to nodes.  A batch locates the exit node of every pending string by
fat binary search - one join on the handle table per halving, at most log2(block) + 1 -
and one look-up of the branch that the next turn takes; a comparison of the prefix
hashes with the node's gives the place where the string leaves.  Strings that leave at
one place by one turn form a group, whatever its size: the one with the smallest hash is
inserted as a leaf, the others wait for the next batch; edges are split where strings
leave or end.  Leaders are as good as random, so the number of batches grows like the
logarithm of the number of distinct strings.  Counts of subtrees come from pointer
doubling over parents, and the edges are expanded into one row per prefix at the end.

Defined results: a null role or text is empty; turns of a conversation are ordered by turn
(null first), ties by role, then by the text's SHA-256; repeated rows are turns of
their own; rows with a null conv_id take no part; an empty table gives no node; other
columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_table
from .skew import look_up

BLOCK = 64          # turns a row at most
WAYS = 16           # a handle is copied so often, for the many strings that meet it
HEADS = 9           # a rebuilt conversation takes fewer turns than this from its base
LONG_LIST = 2048    # ids that one row may list; longer lists are hashed as a stream
NODE = ["depth", "x1", "x2"]
EMPTY = hashlib.sha256(b"").hexdigest()


# --- turns and prefixes -----------------------------------------------------------------

def ordered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, part, gid, t1, t2, n_bytes) in tables sorted by range, and the runs of a
    conversation in the parts: conv_id, part, first (gid), before (turns in earlier parts), n
    (turns in all).  No task holds a whole conversation unless it is small."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    thin = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.sha2(text, 256).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("row")]
    run = thin.repartitionByRange(*order).sortWithinPartitions(*order)
    turns = shared_table(run.select("conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("gid"),
                                    F.xxhash64("role", "digest").alias("t1"),
                                    F.xxhash64(F.lit(1), "digest", "role").alias("t2"), "n_bytes"), "trie-turns")
    runs = turns.groupBy("conv_id", "part").agg(F.min("gid").alias("first"), F.count(F.lit(1)).alias("here"))
    along = Window.partitionBy("conv_id").orderBy("part")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.sum("here").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("here")
    runs = runs.select("conv_id", "part", "first", before.alias("before"), F.sum("here").over(whole).alias("n"))
    return turns, shared_table(runs, "trie-runs")


def taken(conv_id: Column) -> Column:
    """How many turns a rebuilt conversation takes from its base at most."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(HEADS))


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, ends): conv_id, pos (from 0), t1, t2, n_bytes of the rebuilt conversations,
    and each conversation's number of turns."""
    turns, runs = ordered_turns(conversations)
    convs = runs.groupBy("conv_id").agg(F.max("n").alias("n")).select(
        "conv_id", "n", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), taken(F.col("conv_id")).alias("h"))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = shared_table(convs.join(bases, "base", "left").select(
        "conv_id", "base", "h", "n", F.least("h", F.coalesce("n_base", F.lit(0))).alias("from_base")), "trie-conversations")
    placed = runs.drop("n").join(convs.select("conv_id", "h", (F.col("from_base") - F.col("h")).alias("shift")), "conv_id")
    ranked = shared_table(turns.join(placed, ["conv_id", "part"]).select(
        "conv_id", (F.col("gid") - F.col("first") + F.col("before")).alias("pos"), "t1", "t2", "n_bytes", "h", "shift"), "trie-ranked")
    own = ranked.where(F.col("pos") >= F.col("h")).select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "t1", "t2", "n_bytes")
    heads = ranked.where(F.col("pos") < HEADS - 1).select(F.col("conv_id").alias("base"), "pos", "t1", "t2", "n_bytes").join(
        convs.select(F.col("conv_id").alias("to"), "base", "h"), "base").where(F.col("pos") < F.col("h"))
    ends = convs.select("conv_id", (F.col("from_base") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))
    return own.unionByName(heads.select(F.col("to").alias("conv_id"), "pos", "t1", "t2", "n_bytes")), ends


def block_strings(turns: DataFrame, block: int) -> DataFrame:
    """One row per conversation and block: conv_id, d0 (turns before the block), m (turns in
    it), r1, r2, r3 (prefix hashes and bytes before it), path (those after each of its turns)."""
    e1, e2 = F.xxhash64("pos", "t1", "t2"), F.xxhash64("t2", "pos", "t1")
    cut = turns.select("conv_id", F.floor(F.col("pos") / block).alias("k"), "pos", e1.alias("e1"), e2.alias("e2"), "n_bytes")
    so_far = Window.partitionBy("conv_id", "k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.select("conv_id", "k", "pos", F.bit_xor("e1").over(so_far).alias("a"), F.bit_xor("e2").over(so_far).alias("b"),
                     F.sum("n_bytes").over(so_far).alias("w"))
    rows = cut.groupBy("conv_id", "k").agg(F.array_sort(F.collect_list(F.struct("pos", "a", "b", "w"))).alias("path"))
    last = F.element_at("path", -1)
    earlier = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("conv_id", (F.col("k") * block).alias("d0"), F.size("path").alias("m"), "path",
                       F.coalesce(F.bit_xor(last["a"]).over(earlier), F.lit(0)).alias("r1"),
                       F.coalesce(F.bit_xor(last["b"]).over(earlier), F.lit(0)).alias("r2"),
                       F.coalesce(F.sum(last["w"]).over(earlier), F.lit(0)).alias("r3"))
    return rows.withColumn("path", F.transform("path", lambda s: F.struct(
        s["a"].bitwiseXOR(F.col("r1")).alias("a"), s["b"].bitwiseXOR(F.col("r2")).alias("b"), (s["w"] + F.col("r3")).alias("w"))))


def prefix(length: Column, path: Column | str = "path") -> Column:
    """The prefix hashes and bytes at a length from 1 to the path's (null outside)."""
    return F.try_element_at(F.col(path) if isinstance(path, str) else path, length)


def two_fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that the highest power of two divides."""
    top = F.length(F.bin(low.bitwiseXOR(high))) - 1
    return F.call_function("shiftleft", F.lit(-1), top).bitwiseAND(high)


# --- the trie ---------------------------------------------------------------------------

def located(pending: DataFrame, nodes: DataFrame, halvings: int) -> DataFrame:
    """The pending strings with the node of the edge that they leave (e, node_path; null if the
    next turn is a new branch), ``a`` (the length of the last node passed) and ``leave`` (the
    length shared with the trie)."""
    here = F.col("d0") + F.col("f")
    at = F.when(F.col("f").isNotNull(), prefix(F.col("f")))
    handles = nodes.withColumn("f", two_fattest(F.col("p"), F.col("e"))).select(
        (F.col("d0") + F.col("f")).alias("kd"), prefix(F.col("f"))["a"].alias("k1"), prefix(F.col("f"))["b"].alias("k2"),
        F.col("p").alias("np"), F.col("e").alias("ne"), prefix(F.col("e"))["a"].alias("n1"), prefix(F.col("e"))["b"].alias("n2"),
        F.explode(F.sequence(F.lit(0), F.lit(WAYS - 1))).alias("kw"))
    now = pending.withColumns({"a": F.lit(0), "z": F.col("m")})
    for _ in range(halvings):
        now = now.withColumn("f", F.when(F.col("a") < F.col("z"), two_fattest(F.col("a"), F.col("z"))))
        # a string whose search has ended asks for a handle that no node has (length -1)
        now = now.withColumns({"kd": F.coalesce(here, F.lit(-1)), "k1": F.coalesce(at["a"], F.col("s1")),
                               "k2": F.coalesce(at["b"], F.col("s2")), "kw": F.pmod(F.xxhash64("s1", "s2"), F.lit(WAYS)).cast("int")})
        now = now.join(handles, ["kd", "k1", "k2", "kw"], "left")
        end = prefix(F.col("ne"))
        through = (F.col("ne") <= F.col("m")) & (end["a"] == F.col("n1")) & (end["b"] == F.col("n2"))
        now = now.withColumns({
            "a2": F.when(F.col("f").isNull() | F.col("ne").isNull(), F.col("a")).when(through, F.col("ne")).otherwise(F.col("np")),
            "z2": F.when(F.col("f").isNull(), F.col("z")).when(F.col("ne").isNull(), F.col("f") - 1)
            .when(through, F.col("z")).otherwise(F.col("np"))})
        now = now.select(*pending.columns, F.col("a2").alias("a"), F.col("z2").alias("z"))
    now = now.where(F.col("a") < F.col("m")).drop("z")  # others end at a node that exists
    step = prefix(F.col("a") + 1)
    now = shared_table(now.withColumns({"kd": F.col("d0") + F.col("a") + 1, "k1": step["a"], "k2": step["b"]}), "trie-found")
    step = prefix(F.col("p") + 1)
    edges = nodes.select((F.col("d0") + F.col("p") + 1).alias("kd"), step["a"].alias("k1"), step["b"].alias("k2"), "e",
                         F.col("path").alias("node_path"))
    found = look_up(now, edges, ["kd", "k1", "k2"], "left").drop("kd", "k1", "k2")
    same = F.filter(F.sequence(F.col("a") + 1, F.least("e", "m")), lambda j: (
        (prefix(j)["a"] == prefix(j, "node_path")["a"]) & (prefix(j)["b"] == prefix(j, "node_path")["b"])))
    return found.withColumn("leave", F.when(F.col("e").isNull(), F.col("a")).otherwise(F.col("a") + F.size(same)))


def chosen(found: DataFrame) -> DataFrame:
    """The located strings with ``leads``: whether one is inserted now.  Of those that leave the
    trie at one place by one turn it is the one with the smallest hash."""
    step = prefix(F.col("leave") + 1)
    group = [(F.col("d0") + F.col("leave") + 1).alias("gd"), step["a"].alias("g1"), step["b"].alias("g2")]
    luck = F.struct(F.xxhash64("s1", "s2").alias("luck"), "s1", "s2")
    firsts = found.where(F.col("leave") < F.col("m")).groupBy(*group).agg(F.min(luck).alias("first"))
    firsts = firsts.select(F.col("first.s1").alias("s1"), F.col("first.s2").alias("s2"), F.lit(True).alias("leads"))
    return found.join(firsts, ["s1", "s2"], "left")


def grown(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """The nodes with edges split where strings leave or end, and with the leaders as leaves."""
    end = prefix(F.col("e"), "node_path")
    splits = found.where(F.col("leave") < F.col("e")).select(
        (F.col("d0") + F.col("e")).alias("depth"), end["a"].alias("x1"), end["b"].alias("x2"), "leave")
    splits = splits.groupBy(*NODE).agg(F.collect_set("leave").alias("cuts"))  # at most ``block`` lengths
    end = prefix(F.col("e"))
    cut = nodes.withColumns({"depth": F.col("d0") + F.col("e"), "x1": end["a"], "x2": end["b"]}).join(splits, NODE, "left")
    ends = F.array_sort(F.concat(F.coalesce("cuts", F.array().cast("array<int>")), F.array("e")))
    starts = F.concat(F.array("p"), F.slice(ends, 1, F.size(ends) - 1))
    pieces = cut.select("d0", "r1", "r2", "r3", "path", F.inline(F.arrays_zip(starts.alias("p"), ends.alias("e"))))
    leaves = found.where("leads").select("d0", "r1", "r2", "r3", "path", F.col("leave").alias("p"), F.col("m").alias("e"))
    return pieces.unionByName(leaves)


def build(strings: DataFrame) -> DataFrame:
    """Distinct strings -> compacted nodes (d0, r1, r2, r3, path, p, e)."""
    last = F.element_at("path", -1)
    pending = shared_table(strings.withColumns({"s1": last["a"], "s2": last["b"]}).groupBy("d0", "m", "s1", "s2").agg(
        *[F.any_value(c).alias(c) for c in ("r1", "r2", "r3", "path")]), "trie-strings")
    nodes = shared_table(pending.limit(0).select("d0", "r1", "r2", "r3", "path", F.col("m").alias("p"), F.col("m").alias("e")), "trie-nodes")
    longest = pending.agg(F.max("m")).first()[0]  # at most ``block``
    halvings = int(longest or 0).bit_length()
    while not pending.isEmpty():
        found = shared_table(located(pending, nodes, halvings), "trie-located")
        found = shared_table(chosen(found), "trie-chosen")
        nodes = shared_table(grown(nodes, found), "trie-nodes")
        pending = found.where((F.col("leave") < F.col("m")) & F.col("leads").isNull()).select(*pending.columns)
    return nodes


# --- members and subtrees -----------------------------------------------------------------

def _id_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, x1, x2, conv_id, w) -> the decimal ids of a node, so many a row."""
    names = [*NODE, "low", "n", "w", "ids"]
    schema = pa.schema([(n, pa.int64()) for n in names[:-1]] + [("ids", pa.string())])
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        keys = list(zip(*columns[:3], strict=True))
        rows, start = [], 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start] or i - start == LONG_LIST:
                ids = columns[3][start:i]
                rows.append(dict(zip(names, (*keys[start], ids[0], len(ids), columns[4][start], ",".join(map(str, ids))), strict=True)))
                start = i
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, x1, x2, low, n, w, ids) -> a row a node, its list hashed as a stream."""
    names = [*NODE, "low", "n", "w", "ends_sha256"]
    schema = pa.schema([(n, pa.int64()) for n in names[:-1]] + [("ends_sha256", pa.string())])
    now, state = None, None  # a node's first row with the count so far, and its running digest
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            ids = row.pop("ids").encode()
            if now is not None and all(row[n] == now[n] for n in NODE):
                now["n"] += row["n"]
                state.update(b"," + ids)
                continue
            if now is not None:
                done.append(now | {"ends_sha256": state.hexdigest()})
            now, state = row, hashlib.sha256(ids)
        yield pa.RecordBatch.from_pylist(done, schema=schema)
    if now is not None:
        yield pa.RecordBatch.from_pylist([now | {"ends_sha256": state.hexdigest()}], schema=schema)


def end_lists(ends: DataFrame) -> DataFrame:
    """Conversations by the node where they end (depth, x1, x2, conv_id, w) -> per node low
    (smallest conv_id), n, w (bytes up to it) and ends_sha256.  The ids are sorted by range,
    joined to texts in parallel and hashed text by text, in constant memory: one node's list
    of any length is a few rows in the second step."""
    order = [*NODE, "conv_id"]
    texts = ends.select(*order, "w").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _id_texts, "depth long, x1 long, x2 long, low long, n long, w long, ids string")
    return texts.repartition(*NODE).sortWithinPartitions(*NODE, "low").mapInArrow(
        _digests, "depth long, x1 long, x2 long, low long, n long, w long, ends_sha256 string")


def subtree_sums(tree: DataFrame) -> DataFrame:
    """Nodes (depth, x1, x2, up: parent or null, low, n, ww, bytes, leaves) with the smallest
    ``low`` and the sums of the others over their subtrees.  Step i adds the sums of the nodes
    whose ancestor at distance 2^i one is: as many steps as the depth has binary digits."""
    sums = ("n", "ww", "bytes", "leaves")
    at = [f"a_{c}" for c in NODE]
    while True:
        climbing = tree.where(F.col("up").isNotNull())
        if climbing.isEmpty():
            return tree.drop("up")
        gained = climbing.groupBy(*[F.col("up")[c].alias(c) for c in NODE]).agg(
            F.min("low").alias("g_low"), *[F.sum(c).alias(f"g_{c}") for c in sums])
        # many nodes may have one ancestor: its row is copied, a node asks for the copy its hash names
        above = climbing.select(*[F.col(c).alias(f"a_{c}") for c in NODE], F.col("up").alias("above"),
                                F.explode(F.sequence(F.lit(0), F.lit(WAYS - 1))).alias("way"))
        own = [F.coalesce(F.col("up")[c], F.lit(-1) if c == "depth" else F.col(c)).alias(f"a_{c}") for c in NODE]
        tree = tree.select("*", *own, F.pmod(F.xxhash64("x1", "x2"), F.lit(WAYS)).cast("int").alias("way"))
        climbed = tree.join(above, [*at, "way"], "left").join(gained, NODE, "left")
        tree = shared_table(climbed.select(
            *NODE, F.col("above").alias("up"), F.least("low", "g_low").alias("low"),
            *[(F.col(c) + F.coalesce(f"g_{c}", F.lit(0))).alias(c) for c in sums]), "trie-sums")


def prefix_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations: conv_id (smallest member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, ends = rebuilt_turns(conversations)
    strings = shared_table(block_strings(turns, block), "trie-blocks")
    nodes = build(strings.drop("conv_id"))

    # where conversations end
    last = F.element_at("path", -1)
    tops = strings.select("conv_id", (F.col("d0") + F.col("m")).alias("depth"), last["a"].alias("x1"), last["b"].alias("x2"), last["w"].alias("w"))
    at_end = ends.join(tops, (ends["conv_id"] == tops["conv_id"]) & (ends["n"] == tops["depth"]), "left").select(
        ends["conv_id"], *[F.coalesce(c, F.lit(0)).alias(c) for c in (*NODE, "w")])
    closed = shared_table(end_lists(at_end), "trie-closed")

    # compacted nodes, their parents, their own counts
    end, start = prefix(F.col("e")), F.when(F.col("p") > 0, prefix(F.col("p")))
    edges = nodes.select((F.col("d0") + F.col("e")).alias("depth"), end["a"].alias("x1"), end["b"].alias("x2"),
                         F.struct((F.col("d0") + F.col("p")).alias("depth"), F.coalesce(start["a"], F.col("r1")).alias("x1"),
                                  F.coalesce(start["b"], F.col("r2")).alias("x2")).alias("up"),
                         (end["w"] - F.coalesce(start["w"], F.col("r3"))).alias("bytes"),
                         F.coalesce(start["w"], F.col("r3")).alias("w0"), "d0", "p", "e", F.transform(
                             F.slice("path", F.col("p") + 1, F.col("e") - F.col("p")), lambda s: s["w"]).alias("steps"))
    zero = F.lit(0).cast("long")
    root = ends.limit(1).select(zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), F.lit(None).cast(
        "struct<depth:bigint,x1:bigint,x2:bigint>").alias("up"), zero.alias("bytes"), zero.alias("w0"), zero.alias("d0"),
        F.lit(0).alias("p"), F.lit(0).alias("e"), F.array(zero).alias("steps"))
    edges = shared_table(edges.unionByName(root), "trie-edges")
    children = edges.where(F.col("up").isNotNull()).groupBy(*[F.col("up")[c].alias(c) for c in NODE]).agg(F.count(F.lit(1)).alias("children"))
    tree = edges.join(closed, NODE, "left").join(children, NODE, "left")
    own = shared_table(tree.select(*NODE, "up", "low", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("n") * F.col("w"), F.lit(0)).alias("ww"),
                                   "bytes", F.when(F.col("children").isNull(), 1).otherwise(0).cast("long").alias("leaves")), "trie-own")
    sums = subtree_sums(own).select(*NODE, "low", "n", "ww", F.col("bytes").alias("all_bytes"), "leaves")
    full = shared_table(tree.drop("low", "n", "w").join(sums, NODE), "trie-full")

    # expand the edges: the prefixes on one edge have the same members
    parents = full.select(*[F.col(c).alias(f"u_{c}") for c in NODE], F.col("low").alias("parent_low"))
    below = full.where(F.col("up").isNotNull()).withColumns({f"u_{c}": F.col("up")[c] for c in NODE})
    below = look_up(below, parents, [f"u_{c}" for c in NODE]).drop(*[f"u_{c}" for c in NODE])
    whole = below.unionByName(full.where(F.col("up").isNull()).withColumn("parent_low", F.lit(None).cast("long")))
    rows = whole.select("*", F.posexplode("steps").alias("i", "w"))
    bottom = F.col("i") == F.size("steps") - 1
    before = F.when(F.col("i") == 0, F.col("w0")).otherwise(F.element_at("steps", F.greatest(F.col("i"), F.lit(1))))
    rest = F.col("all_bytes") - F.col("bytes") + F.element_at("steps", -1) - before
    is_root = F.col("up").isNull()
    return rows.select(
        F.col("low").alias("conv_id"),
        F.when(is_root, 0).otherwise(F.col("d0") + F.col("p") + F.col("i") + 1).cast("long").alias("depth"),
        F.when(is_root | (F.col("i") == 0), F.col("parent_low")).otherwise(F.col("low")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(bottom, F.coalesce("children", F.lit(0))).otherwise(1).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("ww") - F.col("n") * before - rest).alias("saved_tokens"),
        F.when(bottom, F.coalesce("ends_sha256", F.lit(EMPTY))).otherwise(F.lit(EMPTY)).alias("ends_sha256"))
