"""The pipeline on odd rows and on planted copies."""

import corpus_pipeline


def test_stages_keep_columns_and_clean_documents(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    n = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, odd)
        rows = docs.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS, name
            docs = spark.createDataFrame(rows, docs.schema)
        if name == "language_id":
            kept = {r["text"] for r in rows}
            assert None not in kept and "" not in kept and "... 12 !!" not in kept
            assert n - len(rows) == 4
        if name == "simhash_near_dedup":
            texts = [r["text"] for r in rows]
            assert len(texts) - len(set(texts)) <= 1  # a row that repeats the id that stays


def test_run(spark, odd):
    out = corpus_pipeline.run(spark, odd)
    assert out.columns == ["doc_id", "lang", "source", "n_pieces", "piece_ids"] and out.count() > 0


def test_empty(spark, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []


def test_a_stage_deletes_what_the_one_before_left_unless_it_is_read(spark, odd, tmp_path):
    import os

    import corpus_pipeline

    path = lambda t: t._written_to.removeprefix("file:")
    docs = spark.read.parquet(f"{odd}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    out = corpus_pipeline.drop_near_copies(spark, docs, odd)
    left = list(corpus_pipeline._left)
    assert any(os.path.exists(path(t)) for t in left)
    # Not written by the caller: the next stage reads the table, so it stays.
    n = out.count()
    assert corpus_pipeline.cut_repeats(spark, out, odd).count() == n
    out.write.parquet(f"{tmp_path}/out")
    corpus_pipeline.cut_repeats(spark, spark.read.parquet(f"{tmp_path}/out"), odd)
    assert not any(os.path.exists(path(t)) for t in left if path(t) not in " ".join(out.inputFiles()))
