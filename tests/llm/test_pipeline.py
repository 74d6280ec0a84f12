"""The pipeline: every stage on what the one before it kept."""

from __future__ import annotations

import collections
import random

import corpus_pipeline
from oddsloom.llm import decontaminate, queries

SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "repeats", "decontamination", "packing"]
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == names and counts[-1] <= counts[-2]
            assert docs.select("doc_id").distinct().count() == counts[-1]
    assert counts[4] >= 0.6 * counts[0]
    clean = spark.read.parquet(f"{tmp_path}/3")
    assert decontaminate.find_leaks(clean, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == {r.doc_id for r in clean.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, SF).count() == counts[5]


def test_stages_on_odd_tables(spark, tmp_path):
    r = random.Random(3)
    voc = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(800)]
    prose = lambda n: " ".join(r.choice(voc) for _ in range(n))
    a, passage = prose(120), prose(70)
    texts = [(1, a), (1, a), (1, prose(90)), (None, prose(60)), (None, prose(60)), (2, a.upper()), (3, None), (4, ""), (5, " \n "), (6, prose(5000)), (7, prose(40) + " " + passage), (8, passage + " " + prose(50)), (9, "word " * 400)]
    extra = "rid long, spans string, key int, fp long, grp string, score double, hash binary, uid int"
    docs = spark.createDataFrame([(i, t, None if k % 2 else "en", None, None, *[None] * 8) for k, (i, t) in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, " + extra)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None, 1), (None, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, prose(30)), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        assert now.columns == docs.columns
    rows = collections.Counter((x.doc_id, x.text) for x in now.collect())
    assert rows[1, a] == 1 and (2, a.upper()) not in rows and rows[1, texts[2][1]] == 1 and sum(n for (i, _), n in rows.items() if i is None) == 2
    assert sum(t is None or not t.split() for _, t in rows) == 1 and rows[6, texts[9][1]] == 1
    assert rows[7, texts[10][1]] == 1 and (8, texts[11][1]) not in rows and any(i == 8 for i, _ in rows)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in packed} == {i for i, _ in rows}
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_all_queries_are_registered():
    assert sorted(int(q.split("_")[0][2:]) for q in queries.queries()) == list(range(1, 14))
