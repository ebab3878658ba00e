"""Each stage of the corpus pipeline, judged on its own input, against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import corpus_pipeline
from test_dedup import brute_parts, brute_wide, normal


def words(text: str | None) -> int:
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = corpus_pipeline.materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        assert docs.columns == columns, name
        kept[name] = (before, docs.collect())
    before, after = kept["toxicity"]
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.toxic}
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    labelled = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.toxic is not None}
    judged = {r.doc_id for r in before} & labelled
    assert len(judged & toxic & gone) >= 0.8 * len(judged & toxic) and len((judged - toxic) & gone) <= 0.05 * len(judged - toxic)
    before, after = kept["exact dedup"]
    least = {}
    for r in before:
        least[normal(r.text)] = min(r.doc_id, least.get(normal(r.text), r.doc_id))
    assert sorted(r.doc_id for r in after) == sorted(least.values())
    before, after = kept["near dedup"]
    pairs = [(r.doc_id, brute_parts(r.text, 5, 4)) for r in before]
    assert sorted(r.doc_id for r in after) == sorted(set(brute_wide(pairs, 8, 44).values()))
    before, after = kept["mixing"]
    copies, size = Counter(r.doc_id for r in after), {r.doc_id: words(r.text) for r in before}
    assert set(copies) <= set(size) and max(copies.values()) <= 3
    total = sum(size.values())
    assert abs(sum(size[i] * n for i, n in copies.items()) - total) <= 5 * max(size.values())
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert Counter((r.doc_id, r.decoded_sha256) for r in encoded) == Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in after)
