import collections

import corpus_pipeline
from clipfold.llm.queries import QUERIES


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        rows = docs.collect()
        now = {r.doc_id for r in rows}
        assert docs.columns == columns and now and now <= before and len(rows) == len(now), name
        before = now
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    total = collections.Counter()
    for r in pieces:
        total[r.doc_id] += r.length
    assert set(total) == before and all(total[r.doc_id] == r.doc_tokens for r in pieces)


def test_stages_take_odd_rows(spark, odd, nothing, odd_rows):
    folder = "/root/testdata/sf0.001"
    copies = collections.Counter(r[0] for r in odd_rows)
    got = {name: collections.Counter(r.doc_id for r in stage(spark, odd, folder).collect()) for name, stage in corpus_pipeline.STAGES}
    # The others have fewer than 50 words; 5 stands beside copies alone, whose sketch has no width.
    assert {k: n for k, n in got["quality"].items() if k != 5} == {k: copies[k] for k in (6, 7, 8)}
    kept = got["line_dedup"]
    assert {0, 1, 2, 3, 5, 6, 9, 10, 11} <= set(kept) and not {4, 7} & set(kept) and all(n == copies[k] for k, n in kept.items())
    assert got["near_dedup"] == dict.fromkeys((0, 1, 2, 3, 5, 6, 9, 10, 11), 1)
    assert all(n == copies[k] for k, n in got["mixing"].items())
    assert set(got["packing"]) == set(copies)
    tokens = collections.Counter()
    for r in corpus_pipeline.STAGES[-1][1](spark, odd, folder).collect():
        tokens[r.doc_id, r.doc_tokens] += r.length
    assert all(n == size * copies[k] for (k, size), n in tokens.items())
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, folder).count() == 0, name
