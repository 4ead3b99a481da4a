"""The pipeline's stages on each other's results."""
import corpus_pipeline as cp

from cartograph.llm import pii, quality
from cartograph.llm.common import Scratch
from cartograph.llm.simhash import fingerprint

D = "/root/testdata/sf0.001"


def test_stages(spark):
    scratch = Scratch(spark, "t")
    docs = spark.read.parquet(f"{D}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality_rules", "simhash_dedup", "pii_redaction", "source_mixing", "best_fit_packing"]
    results = [docs]
    for name, f in cp.STAGES:
        results.append(scratch.save(f(spark, results[-1], D), name))
        assert name == names[-1] or results[-1].columns == docs.columns
    raw, good, single, clean, mix, packed = [r.collect() for r in results]
    judged = {r.doc_id: r.kept for r in quality.rules(docs).collect()}
    assert {r.doc_id for r in good} == {i for i, k in judged.items() if k}
    prints = {r.doc_id: fingerprint(r.text.encode()) & (1 << 64) - 1 for r in good}
    kept = {r.doc_id for r in single}
    for i, f in prints.items():  # whoever goes has an earlier neighbour; no two that stay are neighbours
        near = [j for j, g in prints.items() if j != i and (f ^ g).bit_count() <= 3]
        assert i in kept or any(j < i for j in near) or near
        assert i not in kept or not any(j in kept for j in near)
    assert {r.doc_id: r.text for r in clean} == {r.doc_id: pii.redacted(r.text) for r in single}
    assert all(r.n_chars == len(r.text) for r in clean)
    assert {r.doc_id for r in mix} <= {r.doc_id for r in clean}
    assert sum(1 for r in packed if r.piece == 0) == len(mix)
    assert sorted(map(str, packed)) and {r.doc_id for r in packed} == {r.doc_id for r in mix}


def test_run_and_empty_input(spark):
    rows = cp.run(spark, D).count()
    assert rows > 0
    empty = spark.read.parquet(f"{D}/documents.parquet").limit(0)
    scratch = Scratch(spark, "t")
    for name, f in cp.STAGES:
        empty = scratch.save(f(spark, empty, D), name)
        assert empty.count() == 0
