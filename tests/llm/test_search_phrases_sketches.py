"""op11 to op13 against brute force and SQL, and on nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsloom.llm import collocations, fastsketch, lexical, queries, setjoin
from oddsloom.llm.store import Scratch
from tests.oracle import compare, duck

from test_operators import frame, odd_rows

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, odd_rows())


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, odd_rows()).filter("false")


@pytest.mark.parametrize("name", ["op11_stripes_collocations", "op12_dense_blocked_search"])
def test_queries_equal_their_sql(spark, name):
    assert compare(queries.queries()[name](spark, SF), duck(SF), queries.oracle_sql()[name]) == ""


# --- op11


def phrases_by_brute_force(rows, least, top):
    count, total = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            count.update((lang, tuple(words[i : i + m])) for m in range(1, 6) for i in range(len(words) - m + 1))
    often = {k: n for k, n in count.items() if len(k[1]) > 1 and n >= least}
    inside = collections.Counter()
    for (lang, p), n in often.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                inside[lang, p[i : i + m]] = max(inside[lang, p[i : i + m]], n)
    out = collections.defaultdict(list)
    for (lang, p), a in often.items():
        if inside[lang, p] >= a:
            continue
        score, _, l, r = min((1000 * a * total[lang] // (count[lang, p[:k]] * count[lang, p[k:]]), k, count[lang, p[:k]], count[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return {(lang, k + 1, p.decode(), -a, l, r, total[lang], -s) for lang, x in out.items() for k, (s, a, p, l, r) in enumerate(sorted(x)[:top])}


def test_phrases_equal_brute_force(spark, odd, nothing, monkeypatch):
    for least, top in ((2, 2000), (5, 7)):
        got = [tuple(r) for r in collocations.collocations(odd, least, top).collect()]
        want = phrases_by_brute_force([(r.lang, r.text) for r in odd.collect()], least, top)
        assert len(got) == len(set(got)) and set(got) == want and want
    assert collocations.collocations(nothing).collect() == []
    # every prefix cut into parts, counters passed on early, a bitmap with many false hits
    monkeypatch.setattr(collocations, "HOT_SHARE", 10**9)
    monkeypatch.setattr(collocations, "HELD", 64)
    got = {tuple(r) for r in collocations.collocations(odd, 2, 2000).collect()}
    assert got == phrases_by_brute_force([(r.lang, r.text) for r in odd.collect()], 2, 2000)


def test_prefixes_that_no_word_can_follow_leave_no_stripe(spark, tmp_path):
    # every pair of neighbours occurs 6 times, no triple more than twice
    words = [f"w{k}" for k in range(12)]
    r = random.Random(5)
    texts = [f"{a} {b}" for a in words for b in words for _ in range(6)] + [" ".join(r.sample(words, 3)) for _ in range(40)]
    docs = spark.createDataFrame([("en", t) for t in texts], "lang string, text string")
    share = spark.sparkContext.broadcast
    vocabulary = collocations.vocabulary(docs, 6)
    salt = np.uint64(collocations.language_hash("en"))
    one = [(int((np.array([w.h]).view(np.uint64) + salt).view(np.int64)[0]),) for w in vocabulary.filter("h != 0").collect()]
    seqs = Scratch(spark, "t").save(collocations.sequences(docs, share(collocations.bitmap(spark.createDataFrame(one, "key long")))))
    none = share(np.zeros(0, np.uint64))
    level = lambda length, known: collocations.stripes(seqs, length, known, share(collocations.bitmap(collocations.may_be_frequent(seqs, length, known, 6, 10_000), hashed=True)), none, 6).collect()
    pairs = level(1, None)
    assert len(pairs) == 12 and all(len(x.nexts) == 12 for x in pairs)
    known = share(collocations.bitmap(spark.createDataFrame([(k,) for x in pairs for k in x["keys"]], "key long")))
    assert level(2, known) == []


def test_stripes_do_not_grow_with_the_splits_of_the_input(spark):
    # each of 48 splits holds every pair: one stripe of a prefix for each split would be 48 for each prefix
    words = [f"w{k}" for k in range(12)]
    docs = spark.createDataFrame([("en", f"{a} {b}") for _ in range(48) for a in words for b in words], "lang string, text string")
    share = spark.sparkContext.broadcast
    salt = np.uint64(collocations.language_hash("en"))
    one = [(int((np.array([w.h]).view(np.uint64) + salt).view(np.int64)[0]),) for w in collocations.vocabulary(docs, 6).filter("h != 0").collect()]
    seqs = collocations.sequences(docs.repartition(48), share(collocations.bitmap(spark.createDataFrame(one, "key long"))))
    allowed = share(collocations.bitmap(collocations.may_be_frequent(seqs, 1, None, 6, 10_000), hashed=True))
    passed = spark.sparkContext.accumulator(0)

    class Hot:  # is asked for once whenever a task passes its stripes on
        @property
        def value(self):
            passed.add(1)
            return np.zeros(0, np.uint64)

    pairs = collocations.stripes(seqs, 1, None, allowed, Hot(), 6).collect()
    assert len(pairs) == 12 and all(x.counts == [48] * 12 for x in pairs)
    assert 1 <= passed.value <= max(2, spark.sparkContext.defaultParallelism)


def test_products_beyond_64_bits_are_exact(spark):
    a, n, l, r = 3_000_000_019, 9_000_000_000_011, 5_000_000_029, 4_000_000_063
    row = spark.createDataFrame([(a, n, l, r)], "a long, n_all long, l long, r long")
    wide = {x: f"cast({x} as decimal(19,0))" for x in ("a", "n_all", "l", "r")}
    assert row.selectExpr(f"(cast(1000 as decimal(5,0)) * {wide['a']} * {wide['n_all']}) div ({wide['l']} * {wide['r']}) AS s").first()["s"] == 1000 * a * n // (l * r)


def test_a_bitmap_knows_its_keys(spark):
    keys = np.random.default_rng(3).integers(-(2**63), 2**63, 5000)
    bits = collocations.bitmap(spark.createDataFrame([(int(x),) for x in keys], "key long"))
    assert collocations.has(bits, keys.view(np.uint64)).all()
    assert collocations.has(bits, np.random.default_rng(4).integers(0, 2**63, 5000).astype(np.uint64)).mean() < 0.01


# --- op12


def ranks_by_brute_force(docs, items, k):
    terms = lambda x: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (x or "").translate(LOWER))
    counts = [(d, collections.Counter(terms(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n_docs, total = len(counts), sum(n for _, _, n in counts)
    df = collections.Counter(t for _, c, _ in counts for t in c)
    out = collections.Counter()
    for item, text in items:
        found = []
        for d, c, n in counts:
            m = 100 - 50 + (50 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, d is None, d))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out.update((item, k_ + 1, d, -s) for k_, (s, _, d) in enumerate(found[:k]))
    return out


@pytest.mark.parametrize("tiles", [(256, 4096, 1 << 19, 4 << 20), (3, 5, 8, 600)])
def test_ranks_equal_brute_force(spark, odd, nothing, monkeypatch, tiles):
    for name, value in zip(("TILE_ITEMS", "TILE_TERMS", "HELD", "BLOCK_BYTES"), tiles, strict=True):
        monkeypatch.setattr(lexical, name, value)
    items = [(1, "a b"), (2, None), (3, ""), (4, "ééé"), (None, "abcd word"), (1, "a b"), (7, "... !"), (8, "日本語 Ⅻ"), (9, "1 2 3 endoftext"), *((100 + k, t) for k, (_, t) in enumerate(odd_rows()[:6]))]
    frame_ = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("x")).withColumn("rid", F.lit(1))
    for k in (2, 50):
        got = collections.Counter(tuple(r) for r in lexical.rank_documents(odd, frame_, k).collect())
        assert got == ranks_by_brute_force([(r.doc_id, r.text) for r in odd.collect()], items, k)
    assert lexical.rank_documents(nothing, frame_).collect() == [] and lexical.rank_documents(odd, frame_.filter("false")).collect() == []


def test_sums_near_the_limit_of_doubles_are_exact():
    r = np.random.default_rng(1)
    x, w = r.integers(0, 10**6, (3, 500)), r.integers(0, 9 * 10**9, (4, 500))
    assert (lexical.products(x.astype(float), w.astype(float)) == (x.astype(object) @ w.T.astype(object)).astype(np.int64)).all()


# --- op13


def components_by_brute_force(rows, similarity=0.85):
    sets = []
    for _, text in rows:
        words = [w for w in re.split("[ \t-\r]+", (text or "").translate(LOWER)) if w]
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    name = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= round(100 * similarity) * (len(sets[i]) + len(sets[j]) - both):
                a, b = name[i], name[j]
                name = [min(a, b) if x in (a, b) else x for x in name]
    ids = collections.defaultdict(list)
    for k, (d, _) in enumerate(rows):
        ids[name[k]].append(d)
    least = {k: min((d for d in x if d is not None), default=None) for k, x in ids.items()}
    return collections.Counter((d, len(sets[k]), least[name[k]], d == least[name[k]]) for k, (d, _) in enumerate(rows))


def edited(text, words, at, r):
    out = text.split()
    for k in at:
        out[k] = r.choice(words)
    return " ".join(out)


def families(count, shared, own, r):
    """Pairs that differ in one word; all texts share a template."""
    words = [f"w{k}" for k in range(3000)]
    template = [r.choice(words) for _ in range(shared)]
    out = []
    for k in range(count):
        text = " ".join(template + [f"u{k}x{i}" for i in range(own)])
        out += [text, edited(text, words, [r.randrange(shared)], r)]
    return out


def test_components_equal_brute_force(spark, odd, nothing):
    r = random.Random(8)
    words = [f"w{k}" for k in range(500)]
    rows = [(x.doc_id, x.text) for x in odd.collect()]
    for k in range(30):
        base = " ".join(r.choice(words) for _ in range(r.randint(3, 300)))
        n = len(base.split())
        rows += [(1000 + 10 * k + j, edited(base, words, [r.randrange(n) for _ in range(j * n // 120)], r)) for j in range(6)]
    table = frame(spark, rows)
    assert collections.Counter(tuple(x) for x in fastsketch.similar_documents(table).collect()) == components_by_brute_force(rows)
    assert fastsketch.similar_documents(nothing).collect() == []


@pytest.mark.parametrize("crowd", [300, setjoin.CROWD])
def test_pairs_in_a_template_family_are_found(spark, monkeypatch, crowd):
    """All texts share bands; only pairs are similar enough. With a small ``crowd`` the group is split."""
    monkeypatch.setattr(setjoin.verified_classes, "__defaults__", (crowd,))
    rows = list(enumerate(families(60, 80, 9, random.Random(2))))
    got = collections.Counter(tuple(x) for x in fastsketch.similar_documents(frame(spark, rows)).collect())
    want = components_by_brute_force(rows)
    assert got == want and sum(not x[3] for x in want) >= 55


def test_links_hidden_behind_leaders_are_found(spark):
    """In one bucket: a leader, and two pairs that are only similar to each other."""
    sets = {1: range(100), 2: range(1000, 1100), 3: range(1003, 1103), 4: range(2000, 2100), 5: range(2001, 2101)}
    near = spark.createDataFrame([(7, k) for k in sets], "key long, id long")
    grams = spark.createDataFrame([(k, len(x), list(x)) for k, x in sets.items()], "id long, n long, grams array<long>")
    got = {x.id: x.component for x in setjoin.verified_classes(near, grams, 0.85, Scratch(spark, "test")).collect()}
    assert {1: 1} | got == {1: 1, 2: 2, 3: 2, 4: 4, 5: 4}


def test_bit_sets_give_the_same_similarities():
    import pyarrow as pa

    r = np.random.default_rng(5)
    base = r.integers(0, 2**60, 400)
    sets = [np.unique(np.where(r.random(400) < 0.05, r.integers(0, 2**60, 400), base)) for _ in range(40)] + [np.zeros(1, np.int64)] * 2
    rows = pa.RecordBatch.from_arrays([pa.array(sets, pa.list_(pa.int64()))], ["grams"])
    i, j = np.triu_indices(42, 1)
    assert np.allclose(setjoin.jaccard_by_bits(rows, i, j), setjoin.jaccard(rows, i, j)) and np.allclose(setjoin.jaccard(rows, i, j), [len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) for a, b in zip(i, j)])


def test_every_coordinate_is_filled_and_agrees_like_jaccard():
    r = np.random.default_rng(6)
    sizes = [0, 1, 2, 30, 400, 5000]
    gram = np.concatenate([r.integers(1, 2**63, n).astype(np.uint64) for n in sizes])
    who = np.repeat(np.arange(len(sizes)), sizes)
    s = fastsketch.sketches(gram, who, len(sizes), 160)
    assert (s[0] == fastsketch.EMPTY).all() and (s[1:] != fastsketch.EMPTY).all()
    agree = []
    for _ in range(60):
        x = r.integers(1, 2**63, 115).astype(np.uint64)
        two = fastsketch.sketches(np.concatenate((x[:100], x[15:])), np.repeat([0, 1], 100), 2, 160)
        agree.append((two[0] == two[1]).mean())
    assert abs(np.mean(agree) - 85 / 115) < 0.02
