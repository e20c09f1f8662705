"""Each stage of the pipeline against what its operator says of its own input."""

import corpus_pipeline

from specmill.llm import decontaminate, mixing, ngram_join, suffix_dedup, toxicity


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, names = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf).cache()
        names.append(name)
        before, after = ({r.doc_id for r in x.select("doc_id").collect()} for x in (docs, out))
        assert after <= before
        if name == "toxicity":
            scored = toxicity.toxicity(spark, docs, spark.read.parquet(f"{sf}/labels.parquet"))
            assert after == {r.doc_id for r in scored.where("predicted = 0").collect()}
        elif name == "near_duplicates":
            classes = ngram_join.ngram_join(spark, docs).collect()
            assert after == {r.class_id for r in classes} and out.count() == len(after)
        elif name == "repeated_passages":
            kept = {r.doc_id: bytes(r.kept).decode(errors="ignore") for r in suffix_dedup.suffix_dedup(spark, docs).collect()}
            assert {r.doc_id: r.text for r in out.collect()} == {i: t for i, t in kept.items() if i in after}
            assert all(not kept[i].strip() for i in before - after)
        elif name == "decontamination":
            leaked = {r.doc_id for r in decontaminate.decontaminate(spark, docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
            assert leaked and after == before - leaked
        elif name == "mixing":
            plan = {r.doc_id: r.copies for r in mixing.mix_sources(spark, docs).collect()}
            assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {i: c for i, c in plan.items() if c}
        if name != "mixing":
            assert out.columns == columns
        docs = out
    assert names == ["toxicity", "near_duplicates", "repeated_passages", "decontamination", "mixing"]
    assert corpus_pipeline.run(spark, sf).count() == docs.count()
