import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries


def test_stages_follow_each_other(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, small))
        counts.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert counts[0] > counts[1] >= counts[2] >= counts[3] > 0 and counts[4] == counts[5] > 0
    again = corpus_pipeline.run(spark, small)
    assert again.exceptAll(docs).isEmpty() and docs.exceptAll(again).isEmpty()


def test_stages_take_an_empty_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    assert docs.collect() == []


def test_stages_take_nulls_repeats_and_names_of_ours(spark, small):
    """Rows with null ids, texts, langs and sources, rows given twice, and columns named like internal ones."""
    given = spark.read.parquet(f"{small}/documents.parquet")
    odd = given.where("doc_id < 40").withColumns(
        {
            "doc_id": F.when(F.col("doc_id") % 3 != 0, F.col("doc_id")),
            "text": F.when(F.col("doc_id") % 5 != 1, F.col("text")),
            "lang": F.when(F.col("doc_id") % 4 != 0, F.col("lang")),
            "source": F.when(F.col("doc_id") % 6 != 0, F.col("source")),
        }
    )
    docs = given.unionByName(odd).unionByName(given.where("doc_id < 30"))
    names = ["_row", "_doc", "_group", "label", "node", "h", "size", "below", "shard", "score", "_h", "source_size"]
    docs = docs.withColumns({n: F.lit(i) for i, n in enumerate(names)})
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, small))
        assert docs.columns == columns, name
        now = docs.count()
        assert 0 < now and (now <= before or name == "source_mixing")
        before = now
        if name == "exact_dedup":
            norm = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]", "")
            assert docs.select(norm).distinct().count() == now
    last = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert last.count() == before and last.where("n_tokens IS NULL OR decoded_sha256 IS NULL").isEmpty()


@pytest.mark.parametrize("n", range(1, 14))
def test_one_query_per_operator(n):
    assert len([q for q in queries() if q.startswith(f"op{n}_")]) == 1


def test_sql_is_registered():
    assert {n for n in oracle_sql() if n.startswith("op")} == {
        "op1_exact_dedup", "op4_quotation_linking", "op7_pivot_topk", "op8_ngram_jaccard_join", "op9_mixing",
        "op11_bwt_dedup", "op12_prefix_trie", "op13_phrases",
    }


