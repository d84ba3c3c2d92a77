"""The pipeline stage by stage, and as the registered query."""

import corpus_pipeline
import __spark_entry__

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_columns_and_decide(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "byte_bpe"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.keep_table(stage(spark, docs, folder), name)
        assert docs.columns == COLUMNS
        left = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert left <= ids and docs.count() == len(left)
        ids = left
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    whole = __spark_entry__.queries()["pipeline"](spark, folder)
    key = lambda r: r["doc_id"]
    assert sorted(whole.collect(), key=key) == sorted(last.collect(), key=key)
    assert {r["doc_id"] for r in last.collect()} == ids


def test_every_operator_has_a_query():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
