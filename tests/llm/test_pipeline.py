"""The pipeline on the smallest tables, and its last stages against plain versions."""

import os

import brute
import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_pipeline(spark):
    import sentencepiece

    import corpus_pipeline as p
    from strandgraph.llm import queries

    assert [n for n, _ in p.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "tokens"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = [(r["doc_id"], r["text"]) for r in docs.collect()]
    scored = {r["doc_id"]: r["predicted"] for r in queries.op6_quality(spark, SF).collect()}
    kept = p.quality_stage(spark, docs, SF)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, v in scored.items() if v} and kept.columns == docs.columns
    lines = {d: (n, g) for d, n, g, _ in brute.op2(plain)}
    after = {r["doc_id"]: r for r in p.line_dedup_stage(spark, docs, SF).collect()}
    assert {*after} == {d for d, (n, g) in lines.items() if n > g or not n}
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())
    near = {r["doc_id"] for r in p.near_duplicates_stage(spark, docs, SF).collect()}
    assert near == {d for d, _, c, _ in brute.op1(plain, 5, 80) if d == c}
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in p.decontamination_stage(spark, docs, SF).collect()}
    assert clean == {r[0] for r in brute.op3(plain, bench) if not r[5]}
    out = p.run(spark, SF)
    assert 0 < out.count() < len(plain) and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sentencepiece
