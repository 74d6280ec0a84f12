"""Close names are found by shared forms: the same as all pairs of a block, without making them."""

from __future__ import annotations

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from oddsloom.operators import entities


def _all_pairs(rows, n, least):
    b = rows.select(F.col("id").alias("b"), "block", F.col("name").alias("m"))
    ratio = F.round(1 - F.levenshtein("name", "m") / F.greatest(F.length("name"), F.length("m")), 6)
    pairs = rows.join(b, "block").filter("id <> b").select(F.col("id").alias("a"), "b", ratio.alias("ratio")).filter(F.col("ratio") >= least)
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("ratio"), "b"))).filter(F.col("place") <= n)


def test_same_as_all_pairs(spark):
    r = random.Random(5)
    base = ["team of the north", "abcdefghi", "abc", "a rather long name of a club, 27", "customer#000000417", "xxxxxxxxxx"]
    rows = []
    for k in range(260):
        s = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(s) + 1)
            s[at : at + r.randint(0, 1)] = r.choice(["", "x", "7", "0"])
        rows.append((k, k % 3, "".join(s)))
    rows += [(300 + k, 1, "the very same name") for k in range(20)] + [(400, 1, None), (401, None, "abcdefghi")]
    df = spark.createDataFrame(rows, "id long, block int, name string")
    got = entities.close_names(df, "id", "block", "name", 5, 0.88).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, _all_pairs(df, 5, 0.88).collect())) and len(got) > 400


def test_a_name_gets_few_forms_whatever_its_block_holds(spark):
    rows = [(f"customer#{k:09d}", [18], [14, 15, 16, 17]) for k in range(10_000)]
    forms = entities._forms(*zip(*rows), 0.8799995)
    assert max(map(len, forms)) <= 6 + 18
    shared = {}
    for one in forms:
        for f in one:
            shared[f["form"]] = shared.get(f["form"], 0) + 1
    assert sum(x * x for x in shared.values()) < 10_000 * 1_000  # all pairs: 10,000 * 10,000


def test_no_table_that_grows_is_broadcast(spark):
    c = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    out = entities.close_names(c, "c_custkey", "c_nationkey", "c_name", 5, 0.88)
    plan = out._jdf.queryExecution().executedPlan().toString()
    sides = [x for x in plan.splitlines() if "BroadcastExchange" in x or "BroadcastHashJoin" in x or "NestedLoop" in x]
    assert not any(x in line for line in sides for x in ("form#", "name#", "other#", "part#"))
    assert plan.count("SortMergeJoin [form#") == 1


def test_rows_without_id_take_no_place_and_characters_beyond_16_bits_count_once(spark):
    rows = [(None, 1, "abcdefghij")] * 9 + [(k, 1, f"abcdefgh\U0001f600{c}") for k, c in enumerate("jklmnopq")] + [(20 + k, 1, f"\U0001f600bcdefghi{c}") for k, c in enumerate("jkl")] + [(30, 1, "abcdefghij"), (31, 1, "abcdefghix")]
    df = spark.createDataFrame(rows, "id long, block int, name string")
    got = entities.close_names(df, "id", "block", "name", 5, 0.88).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, _all_pairs(df, 5, 0.88).collect())) and {30, 31} <= {r.a for r in got}
