"""The pipeline's stages on the smallest documents: each one's own effect, on what the one before it kept."""

import corpus_pipeline
from leakdrift.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF))
        if name != "packing":
            assert out.columns == docs.columns
        seen[name] = out.count()
        if name in ("toxicity", "near_dedup"):
            assert out.join(docs, ["doc_id", "text"], "left_anti").count() == 0
        if name == "line_dedup":
            texts = [r.text for r in out.select("text").collect()]
            kept = [x for t in texts for x in (t or "").split("\n") if x.strip(" \t\n\v\f\r")]
            assert len(kept) == len(set(kept))
        if name == "packing":
            assert out.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0
        docs = out
    assert n > seen["toxicity"] > n // 2 and seen["line_dedup"] == seen["toxicity"] >= seen["near_dedup"] > 0
