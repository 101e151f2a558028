import math

from pyspark.sql import functions as F

from tidecast.llm import quality_rules as Q


def test_held_out_accuracy_and_expression(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    stats = Q.statistics(docs).cache()
    model = Q.fit(stats, Q.train_rows(labels))
    assert model.rules
    scored = stats.select("doc_id", *Q.STATISTICS, model.score().alias("score")).join(labels, "doc_id").where(
        Q.crc_mod("doc_id", 3) == 1).collect()
    right = sum((r.score >= 0.5) == (r.quality == 1) for r in scored)
    assert right >= 0.97 * len(scored)
    for r in scored[:50]:  # the compiled expression against the rules in Python
        z = model.bias + sum(rule.weight for rule in model.rules
                             if all((r[n] <= t) == at_most for n, at_most, t in rule.tests))
        assert math.isclose(r.score, 1 / (1 + math.exp(-z)), rel_tol=1e-9)
    stats.unpersist()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.1), (2, "x", 0.1), (None, "y " * 50_000, 0.1)],
                                 "doc_id long, text string, score double")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = Q.classify(docs, labels).collect()
    assert len(got) == 4 and {r.score for r in got} == {0.5} and {r.predicted for r in got} == {1}
    one = spark.createDataFrame([(5, 0, None), (None, 1, 0), (6, None, 1), (1, 0, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in Q.classify(docs, one).collect()} == {0}
    assert Q.classify(docs.limit(0), labels).count() == 0
    assert sorted((r.doc_id for r in Q.keep_good(docs, labels).collect()), key=str) == [1, 2, 2, None]


def test_statistics_use_whole_texts():
    clean, junk = b"plain words here. " * 4000, b"JUNK!! " * 4000
    assert Q.describe(clean + junk) != Q.describe(clean)
    assert Q.describe(b"") == [0.0] * len(Q.STATISTICS)
    assert F is not None
