"""The pipeline's stages against brute force, and on edge cases."""

from __future__ import annotations

from test_text_operators import EDGE_SCHEMA, brute_components, brute_contamination, brute_pii

import corpus_pipeline
from sightline.llm.common import materialize


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, small), name)
        if name == "packing":
            rows = docs.collect()
            assert {r["doc_id"] for r in rows} == set(before)
            break
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "near_duplicates":
            assert set(after) == {k for k, (_, c) in brute_components(list(before.items())).items() if k == c}
        elif name == "decontamination":
            assert set(after) == {k for k, _, hit, _ in brute_contamination(list(before.items()), bench) if not hit}
        elif name == "personal_data":
            assert set(after) == set(before)
            assert not any(brute_pii(t) for t in after.values())
            assert all(len(r["text"]) == r["n_chars"] for r in docs.collect())
        before = after


def test_stage_edges(spark, small):
    rows = [(1, None, None, None, None), (None, "", "en", None, 3), (2, "word " * 40_000, "en", "s", None), (2, "word " * 40_000, "en", "s", None), (3, "some of these words are here " * 20, None, "s", 1)]
    wide = spark.createDataFrame([(*r, 1, 2, True, "n", "s", "p", "c") for r in rows], EDGE_SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        for df in (wide, wide.limit(0)):
            out = stage(spark, df, small)
            assert out.count() <= df.count() * 30
            if stage is not corpus_pipeline.packing:
                assert out.columns == df.columns
