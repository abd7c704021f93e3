"""The pipeline's stages against plain versions, at the smallest scale."""

import corpus_pipeline
from parchment.llm import ngram_join, quality
from parchment.llm._common import materialize
from test_operators import base, components


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    text = lambda df: {r.doc_id: r.text for r in df.collect()}
    after = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), "test")
        after.append(docs)
    assert all(df.columns == names for df in after[:-1])
    raw, good, unique, clean, mixed = text(spark.read.parquet(f"{sf}/documents.parquet")), *map(text, after[:4])
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(~quality.held_out())
    scores = {r.doc_id: r.score for r in quality.score(spark.read.parquet(f"{sf}/documents.parquet"), quality.fit(spark.read.parquet(f"{sf}/documents.parquet"), labels)).collect()}
    assert good == {d: t for d, t in raw.items() if scores[d] >= quality.THRESHOLD}
    groups = components(sorted(good.items()), 5, 80, 100)
    assert set(unique) == {d for d, (_, c) in groups.items() if c == d}
    assert set(clean) == set(unique) and not any(base(t) for t in clean.values())
    assert set(mixed) <= set(clean)
    assert after[4].groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").count() == 0
    assert ngram_join.link_documents(after[1], k=5, num=80).where("doc_id <> component_id").count() == 0
