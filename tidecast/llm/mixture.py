"""Mixing sources to target weights by subset-sum budget fitting.

Sources in code-point order (null last) weigh 1, 2, 3, repeating, and share
the total size; a target stops at three times its source's size and the excess
is shared again by weight.  A source repeats whole as often as its target
allows; for the remaining budget its documents are counted by exact length,
proportional counts are taken of every length, and a bounded-knapsack dynamic
program spends the last few thousand words exactly.  Which documents of a
length are taken is decided by a seeded hash.

Only counts per (source, length) reach the program, never documents.  A count
is met without ranking a whole group: hash cells of a (source, length) group
are taken whole up to the cell in which the count runs out, and rows are
ranked in that one cell.

Defined results: null text has size 0; documents of size 0 are never taken;
a null doc_id is hashed as such; rows that repeat an id are separate documents;
empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, shared_table

CAP = 3
WEIGHTS = 3          # weights 1..WEIGHTS, repeating
DP_BUDGET = 8192     # words that the dynamic program spends exactly
CELLS = 4096         # hash cells of a (source, length) group


def with_size(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))


def targets(per_source: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, source_size) -> adds weight and target.  One row a source.

    The shares settle when every source holds min(cap * size, level * weight);
    the level is raised from aggregates until no further source meets its cap.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = per_source.withColumn("weight", (F.pmod(F.row_number().over(order) - 1, F.lit(WEIGHTS)) + 1).cast("long"))
    ranked = shared_table(ranked, "mix-sources")
    total, weights = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    if not weights or not total:
        return ranked.withColumn("target", F.lit(0.0))
    level = total / weights
    while True:  # every round caps at least one more source, or ends
        full = F.col("source_size") * cap <= F.lit(level) * F.col("weight")
        held, free = ranked.agg(F.sum(F.when(full, F.col("source_size") * cap).otherwise(0)),
                                F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        raised = (total - held) / free if free else level
        if raised <= level:
            break
        level = raised
    full = F.col("source_size") * cap <= F.lit(level) * F.col("weight")
    return ranked.withColumn("target", F.when(full, (F.col("source_size") * cap).cast("double"))
                             .otherwise(F.lit(float(level)) * F.col("weight")))


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, dp_budget: int = DP_BUDGET) -> np.ndarray:
    """How many documents of each length to take so that their sizes sum to at
    most ``budget``, as near to it as possible once proportional shares are taken."""
    taken = np.zeros(len(lengths), dtype=np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return taken
    if budget >= total:
        return counts.astype(np.int64)
    bulk = max(0, budget - dp_budget)
    taken = (counts * (bulk / total)).astype(np.int64)
    left = budget - int((taken * lengths).sum())
    for i in np.argsort(-lengths, kind="stable"):  # longest first, down to the program's budget
        if left > dp_budget:
            more = min(int(counts[i] - taken[i]), int((left - dp_budget) // lengths[i]))
            taken[i] += more
            left -= more * int(lengths[i])
    # bounded knapsack over the documents still free: reach[s] = item that first made the sum s
    reach = np.full(left + 1, -1, dtype=np.int64)
    made = np.zeros(left + 1, dtype=bool)
    made[0] = True
    items: list[tuple[int, int]] = []
    for i in np.argsort(-lengths, kind="stable"):
        size, free = int(lengths[i]), int(min(counts[i] - taken[i], left // max(1, int(lengths[i]))))
        k = 1
        while free > 0:  # copies in powers of two
            n = min(k, free)
            free -= n
            k *= 2
            step = n * size
            if step > left:
                break
            new = np.zeros_like(made)
            new[step:] = made[:-step]
            new &= ~made
            if new.any():
                reach[new] = len(items)
                made |= new
            items.append((int(i), n))
        if made[left]:
            break
    at = int(np.flatnonzero(made)[-1])
    while at:
        i, n = items[reach[at]]
        taken[i] += n
        at -= n * int(lengths[i])
    return taken


def plan_counts(sizes: DataFrame, per_source: DataFrame, dp_budget: int = DP_BUDGET) -> DataFrame:
    """(source, size) of all documents -> how many of each length get one copy
    more than the source's whole repeats: source, size, n, whole, extra."""
    histogram = (sizes.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
                 .join(per_source, F.expr("source <=> of_source")).drop("of_source"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size", kind="stable")
        length, count = group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
        budget, total = int(round(float(group["target"].iloc[0]))), int((length * count).sum())
        whole = min(budget // total, CAP)
        extra = fit_counts(length, count, budget - whole * total, dp_budget) if whole < CAP else np.zeros_like(count)
        return pd.DataFrame({"source": group["source"], "size": length, "n": count, "whole": whole, "extra": extra})

    return (histogram.withColumn("group", F.struct(F.col("source").isNull(), F.coalesce("source", F.lit(""))))
            .groupBy("group").applyInPandas(lambda g: fit(g), "source string, size long, n long, whole long, extra long"))


def _draw(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id").isNull(), F.col("doc_id"))


def mix(docs: DataFrame, seed: int = 42, dp_budget: int = DP_BUDGET) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words,
    repeats counted) and repeats (copies of the document in the mix)."""
    sized = shared_table(with_size(docs).withColumn("draw", _draw(seed)), "mix-sizes")
    per_source = shared_table(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
                              .withColumnRenamed("source", "of_source"), "mix-targets")
    plan = shared_table(plan_counts(sized.select("source", "size"), per_source, dp_budget), "mix-plan")

    cell = F.shiftrightunsigned("draw", 64 - CELLS.bit_length() + 1)
    rows = sized.withColumn("cell", cell)
    part = plan.where("extra > 0 and extra < n").select(
        F.col("source").alias("p_source"), F.col("size").alias("p_size"), "extra")
    same = F.expr("source <=> p_source and size = p_size")
    cells = (rows.groupBy("source", "size", "cell").agg(F.count(F.lit(1)).alias("in_cell"))
             .join(part, same).withColumn("before", F.sum("in_cell").over(
                 Window.partitionBy("source", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))))
    cut = (cells.withColumn("before", F.coalesce("before", F.lit(0)))
           .where("before < extra and before + in_cell >= extra")
           .select("p_source", "p_size", F.col("cell").alias("cut"), (F.col("extra") - F.col("before")).alias("rest")))
    chosen = (plan.withColumnsRenamed({"source": "p_source", "size": "p_size"})
              .join(cut.withColumnsRenamed({"p_source": "c_source", "p_size": "c_size"}),
                    F.expr("p_source <=> c_source and p_size = c_size"), "left").drop("c_source", "c_size"))
    placed = rows.join(chosen, same, "left").join(per_source, F.expr("source <=> of_source"), "left")
    at_cut = F.col("cell") == F.col("cut")
    once = F.when(F.col("extra") == F.col("n"), 1).when(F.col("cell") < F.col("cut"), 1).otherwise(0)
    rank = F.row_number().over(Window.partitionBy("source", "size", "cell").orderBy("draw", "doc_id"))
    even = placed.where(~F.coalesce(at_cut, F.lit(False))).withColumn("once", F.coalesce(once, F.lit(0)))
    edge = placed.where(at_cut).withColumn("once", F.when(rank <= F.col("rest"), 1).otherwise(0))
    out = even.unionByName(edge)
    repeats = F.coalesce(F.col("whole") + F.col("once"), F.lit(0)).cast("long")
    return out.select("doc_id", "size", "source_size", "target", (repeats * F.col("size")).alias("taken"),
                      repeats.alias("repeats"), "source")


def mixed_documents(docs: DataFrame, seed: int = 42) -> DataFrame:
    """The mix itself: every document as often as it is taken, all columns kept."""
    plan = mix(docs, seed).where("repeats > 0").select(
        F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"),
        F.col("repeats").alias("__repeats"))
    # rows that repeat (doc_id, source, size) share the copies granted to them in turn
    plan = plan.groupBy("__id", "__source", "__size").agg(F.sort_array(F.collect_list("__repeats"), False).alias("__n"))
    rows = docs.withColumn("__words", n_words(F.col("text"))).join(
        plan, F.expr("doc_id <=> __id and source <=> __source and __words = __size"))
    several = F.size("__n") > 1
    single = rows.where(~several).withColumn("__copies", F.col("__n")[0])
    turn = F.row_number().over(Window.partitionBy("__id", "__source", "__size").orderBy(F.xxhash64("text")))
    repeated = rows.where(several).withColumn("__copies", F.coalesce(F.get("__n", turn - 1), F.lit(0)))
    out = single.unionByName(repeated)
    copies = F.array_repeat(F.lit(1), F.col("__copies").cast("int"))
    return out.withColumn("__copy", F.explode(copies)).select(*docs.columns)
