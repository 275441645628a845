"""Each pipeline stage against a brute-force version, on the small tables and on odd ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hearthspark.llm import decontaminate, near_dedup, packing, pii
from hearthspark.llm.queries import tokenizer_path

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for _, step in corpus_pipeline.STAGES:
        out.append(step(spark, out[-1], SMALL).cache())
    return out


def test_all_but_the_last_keep_the_columns(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "pii", "packing"]


def test_language_keeps_clean_documents(stages):
    kept = {r["doc_id"] for r in stages[1].collect()}
    clear = {r["doc_id"] for r in stages[0].collect() if sum(c.isalpha() for c in r["text"] or "") > 100}
    assert len(clear - kept) <= 0.01 * len(clear)


def test_one_of_each_group_stays(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    want = {d for d, _, _, kept in near_dedup.brute_force(rows, 5, 80) if kept}
    assert {r["doc_id"] for r in stages[2].collect()} == want


def test_no_benchmark_passage_is_left(spark, stages):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    before = {d: hit for d, _, hit, *_ in decontaminate.brute_force([(r["doc_id"], r["text"]) for r in stages[2].collect()], items)}
    after = {r["doc_id"]: r for r in stages[3].collect()}
    texts = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    assert all(d in after and after[d]["text"] == texts[d] for d, hit in before.items() if not hit)
    left = decontaminate.brute_force([(d, r["text"]) for d, r in after.items()], items)
    assert not any(hit for _, _, hit, *_ in left) and all(r["n_chars"] == len(r["text"]) for d, r in after.items() if before[d])


def test_no_personal_data_is_left(stages):
    before = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    after = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    assert before.keys() == after.keys() and not any(pii.brute_force(t) for t in after.values())
    for d, t in before.items():
        for kind, a, b in reversed(sorted(pii.brute_force(t), key=lambda s: s[1])):
            assert t[a:b] not in after[d] or len(t[a:b]) < 8
    assert any(t != after[d] for d, t in before.items())


def test_packing_holds_every_token(stages):
    tokens = packing.Tokens(tokenizer_path())
    got: dict[int, dict[int, list[int]]] = {}
    for p in stages[5].collect():
        got.setdefault(p["doc_id"], {})[p["start"]] = p["ids"]
    for r in stages[4].collect():
        ids = [i for s in sorted(got[r["doc_id"]]) for i in got[r["doc_id"]][s]]
        assert ids == np.frombuffer(tokens.encode(r["text"]), "<u4").tolist() + [0]


def test_odd_tables(spark):
    schema = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    odd = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "12 34 !!", "en", "a", 8), (4, "the same text twice " * 5, "en", "a", 1), (4, "the same text twice " * 5, "en", "a", 1), (5, "the same text twice " * 5, None, None, None)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema).withColumn("kept", F.lit("clash"))
        for _, step in corpus_pipeline.STAGES[:-1]:
            docs = step(spark, docs, SMALL).checkpoint()
            assert docs.columns == [*schema.names, "kept"]
        assert {r["doc_id"] for r in docs.collect()} == ({4} if rows else set()) and docs.count() == (1 if rows else 0)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() >= docs.count()
