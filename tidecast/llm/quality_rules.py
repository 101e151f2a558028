"""Quality classifier: a sparse rule ensemble over text statistics.

A random forest of shallow trees on labelled rows proposes conjunctive rules
(every path from a root to a node); a lasso logistic regression weighs the
rules; the rules with a weight are compiled into one Spark column expression
over the statistics, which scores any number of documents inside codegen.

Statistics come from whole texts, in Arrow batches.  Only the text is an input
of a score: labels are used to fit, and language, source and id never.

Defined results: null text counts as empty (all statistics 0, scored as such);
labels that are null are ignored, and each row of a repeated label counts; with
no labelled row the score is 0.5, with one class its share; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import crc_mod, shared_table

MAX_FIT_ROWS = 60_000  # labelled rows that the forest and the lasso are fitted on, at most (about)
TREES, DEPTH = 24, 3
LASSO = 0.002

STATISTICS = ("log_chars", "log_words", "word_length", "longest_word", "upper", "digit", "bang", "pipe", "mark",
              "stop", "other_punctuation", "non_ascii", "line_breaks", "distinct_words", "repeated_next",
              "top_byte")
#: Bytes of each share; every other printable ASCII mark counts as other_punctuation.
GROUPS = {"digit": b"0123456789", "bang": b"!", "pipe": b"|", "mark": b"*$%&#", "stop": b".,;:?"}


def _masks() -> dict[str, np.ndarray]:
    masks = {k: np.isin(np.arange(256), list(v)) for k, v in GROUPS.items()}
    known = np.any(list(masks.values()), axis=0)
    mark = np.array([33 <= c < 127 and not chr(c).isalnum() for c in range(256)])
    masks["other_punctuation"] = mark & ~known
    masks["upper_ascii"] = np.isin(np.arange(256), np.arange(65, 91))
    masks["non_ascii"] = np.arange(256) >= 192  # lead bytes: one a character
    return masks


MASKS = _masks()


def describe(text: bytes) -> list[float]:
    """The statistics of one whole text, in the order of STATISTICS."""
    if not text:
        return [0.0] * len(STATISTICS)
    data = np.frombuffer(text, dtype=np.uint8)
    hist = np.bincount(data, minlength=256)
    words = text.split()
    n, chars = len(words), len(data)
    capital = int(((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)).sum()) if chars > 1 else 0
    letters = hist[65:91].sum() + hist[97:123].sum() + int(hist[0xC3])
    share = {k: hist[m].sum() / chars for k, m in MASKS.items()}
    return [math.log1p(chars), math.log1p(n), (chars - hist[32] - hist[10]) / max(1, n),
            math.log1p(max(map(len, words), default=0)),
            (hist[65:91].sum() + capital) / max(1, letters), share["digit"], share["bang"], share["pipe"],
            share["mark"], share["stop"], share["other_punctuation"], share["non_ascii"], hist[10] / chars,
            len(set(words)) / max(1, n), sum(map(eq, words, words[1:])) / max(1, n), hist[33:].max() / chars]


def statistics(docs: DataFrame, prefix: str = "", keep: tuple[str, ...] | None = None) -> DataFrame:
    """doc_id (or the columns ``keep``) and the statistics of every row's text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id")) if keep is None else docs.select(*keep)
    names = [prefix + s for s in STATISTICS]
    schema = StructType([*rows.schema.fields, *[StructField(s, DoubleType()) for s in names]])
    kept = rows.columns

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = np.array([describe(t) for t in batch.column(len(kept)).to_pylist()]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, found.T)], [*kept, *names])

    text = F.coalesce(docs["text"], F.lit("")).cast("binary").alias("__text")
    given = [F.col("doc_id").cast("long").alias("doc_id")] if keep is None else [F.col(c) for c in keep]
    return docs.select(*given, text).mapInArrow(batches, schema)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is at most, threshold) and its weight."""

    tests: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self, prefix: str = "") -> Column:
        found = F.lit(True)
        for name, at_most, threshold in self.tests:
            value = F.col(prefix + name)
            found = found & (value <= threshold if at_most else value > threshold)
        return found


@dataclass(frozen=True)
class Ensemble:
    rules: tuple[Rule, ...]
    bias: float

    def score(self, prefix: str = "") -> Column:
        """The probability of label 1 as one column expression over the statistics."""
        total = F.lit(self.bias)
        for rule in self.rules:
            total = total + F.when(rule.column(prefix), F.lit(rule.weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def tree_paths(forest) -> list[Rule]:
    """The distinct rules on all paths of a fitted forest (a path's repeated
    tests of one statistic and side are merged into the tighter one)."""
    found: dict[tuple, Rule] = {}

    def walk(node, tests: dict[tuple[str, bool], float]) -> None:
        if tests:
            key = tuple(sorted((n, side, t) for (n, side), t in tests.items()))
            found.setdefault(key, Rule(key))
        if node.getClass().getSimpleName() == "LeafNode":
            return
        name, threshold = STATISTICS[node.split().featureIndex()], float(node.split().threshold())
        for child, at_most in ((node.leftChild(), True), (node.rightChild(), False)):
            old = tests.get((name, at_most))
            new = threshold if old is None else (min if at_most else max)(old, threshold)
            walk(child, tests | {(name, at_most): new})

    for tree in forest.trees:
        walk(tree._call_java("rootNode"), {})
    return list(found.values())


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_FIT_ROWS,
        lasso: float = LASSO, seed: int = 7) -> Ensemble:
    """Fits on rows of ``stats`` whose doc_id ``labels`` (doc_id, label) holds.

    With more than ``max_rows`` labelled rows, about so many are used, chosen
    by a hash of the id."""
    marked = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(label).cast("double").alias("label")
                           ).where("__id IS NOT NULL AND label IS NOT NULL")
    rows = shared_table(stats.join(marked, stats["doc_id"] == marked["__id"]).select("doc_id", "label", *STATISTICS),
                        "quality-labelled")
    n, ones = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or ones in (0, n):
        share = min(max(ones / n, 1e-6), 1 - 1e-6) if n else 0.5
        return Ensemble((), math.log(share / (1 - share)))
    if n > max_rows:
        keep = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000)) < int(1e6 * max_rows / n)
        rows = rows.where(keep)
    sample = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(rows)
    sample = sample.select("label", "features", *STATISTICS).coalesce(8).cache()
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, subsamplingRate=0.5, maxBins=64,
                                    featureSubsetStrategy="onethird", minInstancesPerNode=20, seed=seed).fit(sample)
    rules = tree_paths(forest)
    if not rules:
        sample.unpersist()
        return Ensemble((), math.log(ones / (n - ones)))
    fires = F.array(*[r.column().cast("double") for r in rules])
    from pyspark.ml.functions import array_to_vector
    fired = sample.select("label", array_to_vector(fires).alias("features")).cache()
    lasso_fit = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=60, standardization=False).fit(fired)
    fired.unpersist()
    sample.unpersist()
    weights = lasso_fit.coefficients.toArray()
    kept = tuple(Rule(r.tests, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-9)
    return Ensemble(kept, float(lasso_fit.intercept))


def train_rows(labels: DataFrame) -> DataFrame:
    """Label rows outside the held-out fold (crc32 of the id's text, modulo 3, is not 1)."""
    return labels.where(crc_mod("doc_id", 3) != 1)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    stats = shared_table(statistics(docs), "quality-statistics")
    model = fit(stats, train_rows(labels))
    return stats.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), model.score().alias("score")
                        ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the classifier rejects, all columns kept.

    Every row is judged by its own text where it lies; no text is shuffled."""
    model = fit(shared_table(statistics(docs), "quality-statistics"), train_rows(labels))
    judged = statistics(docs, prefix="__quality_", keep=tuple(docs.columns))
    return judged.where(model.score("__quality_") >= 0.5).select(*docs.columns)
