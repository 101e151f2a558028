import re
import sys
from pathlib import Path

import sentencepiece

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import __spark_entry__  # noqa: E402
import corpus_pipeline as C  # noqa: E402
from tests.llm.test_jaccard_join import brute as near_brute  # noqa: E402
from tidecast.llm import mixture, piece_codec  # noqa: E402

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_every_stage_against_brute_force(spark):
    docs = C.table(spark, SF, "documents")
    labels = {r.doc_id: r.quality for r in C.table(spark, SF, "labels").collect()}
    seen = {}
    for name, stage in C.STAGES:
        before = seen.get("rows") or {r.doc_id: r for r in docs.collect()}
        docs = C.shared_table(stage(spark, docs, SF), f"test-{name}")
        rows = docs.collect()
        if name == "quality":
            assert docs.columns == COLUMNS
            kept = {r.doc_id for r in rows}
            judged = [(labels[i] == 1) == (i in kept) for i in before if i in labels]
            assert kept <= set(before) and sum(judged) >= 0.97 * len(judged)
        elif name == "exact_dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[i].text or ""), i)
            assert sorted(r.doc_id for r in rows) == sorted(first.values()) and docs.columns == COLUMNS
        elif name == "near_copies":
            parts = near_brute([(i, r.text) for i, r in before.items()])
            assert sorted(r.doc_id for r in rows) == sorted(i for i, n, c in parts if not n or c == i)
            assert docs.columns == COLUMNS
        elif name == "mix_sources":
            assert docs.columns == COLUMNS
            plan = {r.doc_id: r for r in mixture.mix(spark.createDataFrame(list(before.values()), docs.schema)).collect()}
            copies = {}
            for r in rows:
                copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
                assert before[r.doc_id].text == r.text
            assert copies == {i: p.repeats for i, p in plan.items() if p.repeats}
            taken = {}
            for p in plan.values():
                taken[p.source] = taken.get(p.source, 0) + p.taken
            assert all(abs(taken[p.source] - p.target) <= 1 for p in plan.values())
        else:
            sp = sentencepiece.SentencePieceProcessor(model_file=piece_codec.MODEL)
            assert name == "encode_pieces" and len(rows) == seen["n"]
            assert all(r.token_ids == sp.encode(before[r.doc_id].text) and r.round_trip for r in rows)
        seen = {"rows": {r.doc_id: r for r in rows}, "n": len(rows)}
    assert C.run(spark, SF).count() == seen["n"]


def test_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert [x for x in names if x.startswith(f"op{n}_")], n
    assert set(__spark_entry__.oracle_sql()) <= set(names)
