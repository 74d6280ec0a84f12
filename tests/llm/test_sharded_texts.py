"""Shards hold whole documents, not only places for them."""

from __future__ import annotations

from oddsloom.llm import queries, sharding

SF = "/root/testdata/sf0.001"


def test_whole_rows_move_to_their_shards(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    placed = sharding.shard_documents(docs, 8)
    rows = placed.collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(key(r.document) for r in rows) == sorted(key(r) for r in docs.collect())
    assert all(r.document.doc_id == r.doc_id for r in rows)


def test_repeated_ids_are_written_once_each(spark, tmp_path):
    docs = spark.createDataFrame([(k // 2, f"text {k} " * 9, k % 3) for k in range(60)], "doc_id long, text string, shard int")
    sharding.write_shards(docs, sharding.shard_documents(docs, 4), f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((r.doc_id, r.text) for r in docs.collect())


def test_the_query_reads_texts_behind_the_exchange(spark):
    plan = queries.queries()["op4_histogram_sort_shards"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    top = plan.split("Exchange ")[0]
    assert "octet_length" in top and "crc32" in top
