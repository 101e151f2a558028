import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tidecast.llm import exact_dedup as X

ROWS = [(3, "a  b"), (1, "a\tb"), (2, "a b "), (7, None), (8, ""), (9, " "), (9, "\n\n"), (4, "a b"), (4, "a b"), (None, "a b"),
        (None, "only null"), (5, "A b"), (6, "a b"), (10, "x" * 100_000), (11, "x" * 100_000), (12, "x" * 99_999 + "y")]


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for n, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        left = 1
        for i in sorted(ids, key=lambda i: (i is None, i or 0)):
            kept = i == keep and left > 0
            left -= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [X.sha256, lambda n: F.substring(F.sha2(n, 256), 1, 1)])
def test_matches_brute_force(spark, digest):
    docs = spark.createDataFrame([(i, t, "d", 1) for i, t in ROWS], "doc_id long, text string, digest string, row_id int").repartition(5)
    got = X.exact_dedup(docs, digest=digest).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == brute(ROWS)


def test_kept_documents_and_empty_table(spark):
    docs = spark.createDataFrame([(i, t, "d") for i, t in ROWS], "doc_id long, text string, digest string")
    kept = X.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r[0] for r in brute(ROWS) if r[3]), key=str)
    assert X.exact_dedup(docs.limit(0)).count() == 0 and X.drop_copies(docs.limit(0)).count() == 0


def test_registered_query_matches_its_sql(spark):
    import duckdb

    from tidecast.llm import catalog
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.execute(catalog.oracle_sql()["op5_exact_dedup"])
    names = [c[0] for c in want.description]
    got = catalog.queries()["op5_exact_dedup"](spark, sf)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
