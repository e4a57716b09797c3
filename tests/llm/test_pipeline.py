"""The pipeline, stage by stage."""

import random

from conftest_llm import ODD, prose


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from flowspark.llm import decontamination, mixing, near_copies, quality

    draw = random.Random(3)
    texts = [*ODD, *(prose(draw, draw.randrange(12, 300), 5000) for _ in range(80))]
    texts += [t + " one more" for t in texts[20:30]] + texts[30:40]
    bench = [(0, prose(draw, 30, 5000)), (1, None)]
    texts += [f"{prose(draw, 40, 5000)} {bench[0][1]}"]
    rows = [(k, t, draw.choice(["en", "de"]), draw.choice(["a", "b", None]), len(t or "")) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "sharding"]
    now, ids = docs, lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    checks = [
        lambda d: sorted(r.doc_id for r in quality.quality(d).collect() if r.kept),
        lambda d: sorted({r.component_id for r in near_copies.near_copies(d).collect()}),
        lambda d: sorted(r.doc_id for r in decontamination.contamination(d, spark.createDataFrame(bench, "item_id long, text string")).collect() if not r.n_hit),
        lambda d: sorted(x for r in mixing.mix(d).collect() for x in [r.doc_id] * r.copies),
    ]
    for (name, stage), want in zip(corpus_pipeline.STAGES[:4], checks, strict=True):
        before = ids(now)
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        assert ids(spark.read.parquet(str(tmp_path / name))) == want(now), name
        now = spark.read.parquet(str(tmp_path / name))
        if name != "mixing sources to target weights":
            assert len(ids(now)) < len(before), name
    last = corpus_pipeline.STAGES[4][1](spark, now, str(tmp_path))
    assert ids(last) == ids(now)
    assert ids(corpus_pipeline.run(spark, str(tmp_path))) == ids(now)
