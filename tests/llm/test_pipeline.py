"""The pipeline's stages in order, and what they keep."""
import corpus_pipeline


def test_pipeline(spark, tmp_path, corpus, docs):
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, None) for i in range(5)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, corpus[2][1])], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "decontamination", "mixing", "token_output"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, folder).collect(), docs.schema)
        ids = {r.doc_id for r in kept.collect()}
        if name == "toxicity":
            assert kept.count() == len(corpus)  # no labels, no rejection
        elif name == "minhash_near_dedup":
            assert not ids & {40, 41, 42, 43} and {0, 1, 50, 51, None} <= ids  # 43 is a copy of 0 at .836, and the stage links from .80
        elif name == "decontamination":
            assert 2 not in ids and {0, 1, 50, 51, None} <= ids
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == kept.count()


def test_empty(spark, tmp_path, nothing):
    folder = str(tmp_path)
    nothing.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []
