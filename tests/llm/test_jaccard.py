import random

import numpy as np
import pytest

from gridloom.llm import jaccard_join as j
from gridloom.llm.shared import components
from tests.llm import brute


def near_copies(seed, n, words):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 5))) for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 8])):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 1)] = ["x" + str(rng.randrange(40))]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("group", [4096, 3])
def test_components_against_all_pairs(spark, monkeypatch, group):
    monkeypatch.setattr(j, "GROUP", group)
    texts = [None, "", " \t\n", "one", "ONE", "one two", "one  two", "a b c d e", "a b c d e f", "É a b c d", "é a b c d"]
    for k in range(12):
        texts += near_copies(k, random.Random(k).randint(1, 12), random.Random(k).choice([6, 12, 40, 120]))
    passage = " ".join(near_copies(99, 1, 40))
    texts += [f"{passage} {' '.join(near_copies(200 + k, 1, 30))}" for k in range(25)]
    texts += [near_copies(0, 1, 6)[0]] * 5
    rows = [(i * 13 % 997, t, 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in j.jaccard_components(df).collect()}
    assert got == brute.components([(d, t) for d, t, _ in rows])


def test_null_and_repeated_keys_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (2, "a b c d e"), (2, "a b c d e"), (2, None), (5, "a b c d e")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in j.jaccard_components(df).collect()), key=str)
    assert got == sorted([(2, 1, 2), (2, 1, 2), (2, 0, 2), (5, 1, 2), (None, 1, None)], key=str)
    assert j.jaccard_components(df.where("false")).count() == 0


@pytest.mark.parametrize(
    "rows, expected",
    [
        ([(1, "T"), (5, "T"), (5, "T"), (7, "U")], {1: 1, 5: 1, 7: 7}),
        ([(1, "T"), (2, "S"), (5, "T"), (5, "S")], {1: 1, 2: 1, 5: 1}),
        ([(1, "T"), (2, "S"), (3, "U"), (9, "S"), (9, None), (9, "near U"), (None, "T"), (4, None)], {1: 1, 2: 2, 3: 2, 9: 2, 4: 4, None: None}),
    ],
)
def test_repeated_keys_that_are_not_the_smallest(spark, rows, expected):
    """One row for each row, one component for each key, with the links of all its rows."""
    texts = {"T": "a b c d e", "S": "f g h i j k", "U": " ".join(map(str, range(60))), "near U": " ".join(map(str, range(59))), None: None}
    df = spark.createDataFrame([(d, texts[t]) for d, t in rows], "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in j.jaccard_components(df).collect()), key=str)
    assert got == sorted(((d, len(brute.shingles(texts[t])), expected[d]) for d, t in rows), key=str)


def test_a_very_long_text(spark):
    long = " ".join(str(i * i % 7919) for i in range(300_000))
    df = spark.createDataFrame([(1, long), (2, long + " tail"), (3, "x")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in j.jaccard_components(df).collect()} == {1: 1, 2: 1, 3: 3}


def test_tree_links_connects_what_links():
    rng = np.random.default_rng(0)
    for _ in range(150):
        n, base = rng.integers(2, 30), rng.choice(10**6, rng.integers(1, 60), replace=False)
        sets = []
        for _ in range(n):
            s = base[rng.random(len(base)) > rng.choice([0, 0.05, 0.1, 0.2])]
            s = np.unique(np.concatenate([s, rng.choice(10**6, rng.integers(0, 1 + len(base) // 6)), [10**7]]))
            sets.append(s.astype(np.uint64))

        def joined(pairs, n=n):
            of = list(range(n))
            for a, b in pairs:
                x, y = of[a], of[b]
                of = [min(x, y) if o in (x, y) else o for o in of]
            return of

        linked = [(a, b) for a in range(n) for b in range(a) if 180 * len(np.intersect1d(sets[a], sets[b])) >= 80 * (len(sets[a]) + len(sets[b]))]
        assert joined(linked) == joined(j.tree_links(sets, np.arange(n)))


def test_components_of_long_paths_and_stars(spark):
    rng = random.Random(1)
    ids = rng.sample(range(10**6), 400)
    edges = list(zip(ids[:200], ids[1:200])) + [(ids[200], x) for x in ids[201:300]] + [(ids[300], ids[300]), (None, 1), (ids[5], ids[6])]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[x] for x in ids[:200]} == {min(ids[:200])} and {got[x] for x in ids[200:300]} == {min(ids[200:300])} and ids[300] not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def listed_rows(labels, picks, n=100):
    k = len(labels)
    t = j.pa.table({"token": np.zeros(k, np.int64), "rep": np.arange(k)[::-1].copy(), "n": np.full(k, n), "label": np.array(labels), "picks": j.pa.array(picks, j.pa.list_(j.pa.int64()))})
    return t.to_batches(max_chunksize=1000)


def test_a_list_of_one_large_label_makes_no_pair_inside_it(monkeypatch):
    """Work on a posting list grows with its members outside the largest label, not with the square of its length."""
    k, made = 6000, []
    labels, picks = [0] * k, [[1, 5]] * k
    for at, label in ((10, 1), (4000, 2), (4001, 2)):
        labels[at], picks[at] = label, [2]
    labels[77], picks[77] = 3, [5, 9]  # has met the large label's members
    unmet = j._unmet
    monkeypatch.setattr(j, "need", lambda n: made.append(np.size(n)) or (4 * n + 4) // 5)
    assert sum(len(x[0]) for x in unmet(j.pa.Table.from_batches(listed_rows(labels, picks)).combine_chunks())) == 3 * (k - 4) + 3
    assert sum(made) < 5 * k
    got = {}
    for b in j._listed(listed_rows(labels, picks)):
        for rep, _, others in zip(*(c.to_pylist() for c in b.columns)):
            got.setdefault(rep, []).extend(np.frombuffer(others, np.int64).reshape(2, -1)[0].tolist())
    at = np.arange(k)[::-1]
    expected = {(min(at[a], at[b]), max(at[a], at[b])) for a in (10, 4000, 4001, 77) for b in range(k) if labels[a] != labels[b] and not set(picks[a]) & set(picks[b])}
    assert sorted((x, y) for x, ys in got.items() for y in ys) == sorted(expected)


@pytest.mark.parametrize("few", [1, 3, 64])
def test_listed_pairs_against_all(monkeypatch, few):
    monkeypatch.setattr(j, "FEW", few)
    monkeypatch.setattr(j, "PAIRS", 5)
    rng, rows = random.Random(few), []
    for token in range(60):
        rows += [(token, rep, 20 + rep % 9, rep % 4, [rep % 5, *[10 + rep % 3] * (rep % 2)]) for rep in rng.sample(range(40), rng.randint(2, 20))]
    cols = [list(c) for c in zip(*rows)]
    t = j.pa.table({"token": cols[0], "rep": cols[1], "n": cols[2], "label": cols[3], "picks": j.pa.array(cols[4], j.pa.list_(j.pa.int64()))})
    got = []
    for b in j._listed(t.to_batches(max_chunksize=7)):
        for rep, n, others in zip(*(c.to_pylist() for c in b.columns)):
            got += [(rep, n, *o) for o in np.frombuffer(others, np.int64).reshape(2, -1).T.tolist()]
    expected = [(a[1], a[2], b[1], b[2]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[3] != b[3] and min(a[2], b[2]) >= j.need(max(a[2], b[2])) and not set(a[4]) & set(b[4])]
    assert sorted(got) == sorted(expected) and got


def test_near_copies_are_connected_by_few_counts(monkeypatch):
    """A group of near copies of one text costs a few comparisons with all, not one for each of them."""
    rng = np.random.default_rng(1)
    base = rng.choice(10**6, 300, replace=False)
    sets = [np.unique(np.append(base[rng.random(300) > 0.02], rng.choice(10**6, 3))).astype(np.uint64) for _ in range(400)]
    calls, count = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **kw: calls.append(1) or count(*a, **kw))
    assert len(list(j.tree_links(sets, np.arange(400)))) == 399
    assert len(calls) < 100


def test_tree_links_with_labels_and_probes():
    rng = np.random.default_rng(5)
    for round_ in range(200):
        n, base = int(rng.integers(2, 40)), rng.choice(10**6, int(rng.integers(5, 60)), replace=False)
        sets = [np.unique(np.append(base[rng.random(len(base)) > rng.choice([0, 0.05, 0.1, 0.2])], rng.choice(10**6, 2))).astype(np.uint64) for _ in range(n)]
        labels, probes = rng.integers(0, n, n), rng.random(n) < rng.choice([0.05, 0.5, 1])
        linked = [(a, b) for a in range(n) for b in range(a) if 180 * len(np.intersect1d(sets[a], sets[b])) >= 80 * (len(sets[a]) + len(sets[b]))]

        def joined(pairs, n=n, labels=labels):
            of = labels.tolist()
            for a, b in pairs:
                x, y = of[a], of[b]
                of = [min(x, y) if o in (x, y) else o for o in of]
            return of

        got = list(j.tree_links(sets, labels, probes))
        assert {tuple(sorted(p, reverse=True)) for p in got} <= set(linked)
        assert joined(got) == joined([(a, b) for a, b in linked if probes[a] or probes[b]])


@pytest.mark.parametrize("copies", [1, 4, 1 << 20])
def test_only_representatives_of_equal_sets_are_posted(spark, monkeypatch, copies):
    """Equal texts in any partitions post their n-grams once, whether or not all their keys can go out."""
    monkeypatch.setattr(j, "COPIES", copies)
    kinds, stored = [], j.stored
    monkeypatch.setattr(j, "stored", lambda df, label, *a, **k: (out := stored(df, label, *a, **k), kinds.append((label, out.count())))[0])
    texts = near_copies(3, 6, 40) * 6 + [" ".join(map(str, range(50)))] * 9
    rows = [(1000 - i * 7 % 997, t) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in j.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(9)).collect()}
    assert got == brute.components(rows)
    if copies > len(rows):
        sets = [brute.shingles(t) for t in set(texts[:36])]
        assert 0 < dict(kinds)["shared"] <= sum(map(len, sets))
