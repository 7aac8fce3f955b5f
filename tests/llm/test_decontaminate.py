import random
from collections import Counter

from gridloom.llm.decontaminate import Index, contamination, split_words
from gridloom.llm.registry import oracle_sql
from tests.llm import brute

import hashlib


def words(rng, n, pool=60):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def test_against_plain_python(spark):
    rng = random.Random(4)
    items = [(10, " ".join(words(rng, 30))), (9, " ".join(words(rng, 10))), (100, "Short Ünit é"), (2, "solo"), (3, None), (4, "..."), (5, " ".join(["same"] * 14)), (10, " ".join(words(rng, 12)))]
    docs = [None, "", "!!", "solo", "SOLO,solo", "short Ünit é", "short ünit é", "same " * 25, "ß" * 50]
    for k in range(80):
        w = words(rng, rng.randint(0, 60))
        if k % 2:
            source = brute.BENCH_WORDS.findall(brute.lowered(rng.choice(items)[1]))
            a = rng.randrange(len(source) + 1)
            w[5:5] = source[a : a + rng.randint(0, 25)]
        docs.append(rng.choice([" ", ", ", "\n"]).join(w).upper() if k % 3 else " ".join(w))
    rows = [(i, t, 1) for i, t in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_hit int").repartition(5)
    got = {r.doc_id: r for r in contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    for d, t, _ in rows:
        n, hit, ids = brute.contamination(t, items)
        r = got[d]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(ids), hit > 0), t
        assert r.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()


def test_null_and_repeated_keys_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "solo"), (1, "solo"), (1, "x solo"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "solo")], "item_id long, text string")
    got = sorted((str(r.doc_id), r.n_hit) for r in contamination(df, items).collect())
    assert got == [("1", 2), ("1", 2), ("2", 0), ("None", 0)]
    assert [r.n_hit for r in contamination(df, items.where("false")).collect()] == [0] * 4
    assert contamination(df.where("false"), items).count() == 0


def test_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = [(1, item), (2, "kappa iota x theta eta zeta y epsilon delta gamma beta alpha"), (3, item.replace("gamma", "g " * 9)), (4, "alpha " * 30), (5, item.replace("zeta", "zeta q q"))]
    d = spark.createDataFrame(docs, "doc_id long, text string").select("doc_id", split_words("text").alias("words"))
    index = Index(d, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert {r.doc_id for r in index.near(2).collect()} == {1, 2, 5}
    assert {r.doc_id for r in index.near(0).collect()} == {1}
    assert {r.doc_id for r in index.phrases().collect()} == {1}


def test_sql_is_registered():
    assert {"op1_chat_format", "op4_jaccard_join", "op6_decontamination", "op10_warc"} <= set(oracle_sql())


def test_proximity_counts_repeated_words(spark):
    rng = random.Random(7)
    items = [(1, "alpha alpha beta gamma delta epsilon zeta eta theta iota"), (2, "same same same"), (3, "solo"), (4, " ".join(words(rng, 14, 8)))]
    docs = [(1, items[0][1]), (2, items[0][1].replace("alpha alpha", "alpha x")), (3, "same x same"), (4, "same x same same"), (5, "alpha alpha beta gamma delta"), (5, "epsilon zeta eta theta iota"), (6, "")]
    docs += [(10 + k, " ".join(words(rng, rng.randint(8, 30), 8))) for k in range(60)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).select("doc_id", split_words("text").alias("words"))
    index = Index(d, spark.createDataFrame(items, "item_id long, text string"))
    for slop in (0, 3):
        want = set()
        for i, item in items:
            v = item.split()
            w = min(len(v), 10)
            for need in [Counter(v[s : s + w]) for s in range(len(v) - w + 1)]:
                want |= {(k, i) for k, t in docs for s in range(len(t.split())) if not need - Counter(t.split()[s : s + w + slop])}
        got = {tuple(r) for r in index.near(slop).collect()}
        assert got == want and (1, 1) in got and (4, 2) in index.near(3).collect() and not {(2, 1), (3, 2), (5, 1)} & got
        assert any(i == 4 for _, i in got) or slop == 0
