import hashlib
import random

import numpy as np

from gridloom.llm.fingerprints import containment, decoded, encoded, fingerprints, fingerprints_beside_next, likeness, merged
from tests.llm.brute import shingles


def prose(seed, n):
    random.seed(seed)
    return " ".join("".join(random.choice("abcdefgh") for _ in range(random.randint(1, 6))) for _ in range(n))


def test_beside_next_against_plain_python(spark):
    texts = [None, "", "one", "é😀x y z w q", prose(1, 400), prose(1, 400)] + [prose(i, random.Random(i).randint(0, 300)) for i in range(60)]
    rows = [(i * 7 % 401, t, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int").repartition(4)
    got = {r.doc_id: r for r in fingerprints_beside_next(df).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    for (d, t, _), (_, nxt, _) in zip(order, order[1:] + order[:1]):
        t, nxt, r = t or "", nxt or "", got[d]
        k = len(t) // 3
        e = t[: len(t) - k] + nxt[:k]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert abs(r.near_edited - likeness(r.fingerprint, r.edited_fingerprint)) < 1e-12
        a, b = shingles(t), shingles(e)
        if len(a | b) > 300:
            assert abs(r.near_edited - len(a & b) / len(a | b)) < 0.2 and r.near_next < 0.1
        assert decoded(r.fingerprint)[0] == len(a)
    assert len(got) == len(rows)


def test_ties_nulls_one_row_and_none(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = fingerprints_beside_next(df).collect()
    assert len(got) == 3 and len({r.fingerprint for r in got if r.doc_id == 1}) == 1
    one = fingerprints_beside_next(df.where("doc_id is null")).collect()
    assert one[0].near_next == 1.0 and one[0].fingerprint == "0:"
    assert fingerprints_beside_next(df.where("false")).count() == 0


def test_containment_of_unequal_documents(spark):
    small, large = prose(8, 500), prose(9, 20_000)
    df = spark.createDataFrame([(1, small), (2, large + " " + small), (3, large), (4, small.upper())], "doc_id long, text string")
    f = {r.doc_id: r.fingerprint for r in fingerprints(df).collect()}
    assert containment(f[1], f[2]) > 0.95 and containment(f[2], f[1]) < 0.1 and f[1] == f[4]
    assert containment(merged(f[1], f[3]), f[2]) > 0.95 and containment("0:", f[1]) == 0.0
    n, codes = decoded(f[2])
    assert encoded(n, codes) == f[2] and (np.diff(codes.astype(np.int64)) > 0).all()


def test_short_texts_are_told_apart(spark):
    texts = [" ".join(prose(i, n).split()[:n]) for n in range(1, 41) for i in range(5)] + ["one", "two", "one two", "one two three four five", "two three four five six"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for scale in (4, 100):
        f = {r.doc_id: r.fingerprint for r in fingerprints(df, scale=scale).collect()}
        sets = [frozenset(shingles(t)) for t in texts]
        assert len(set(f.values())) == len(set(sets))
        for i, a in enumerate(sets):
            for j, b in list(enumerate(sets))[i : i + 12]:
                assert likeness(f[i], f[j], scale) == len(a & b) / len(a | b)
                assert containment(f[i], f[j], scale) == len(a & b) / len(a)
    for r in fingerprints_beside_next(df).collect():
        i = len(texts) - 1 if r.doc_id == 0 else r.doc_id - 1
        t, nxt = texts[r.doc_id], texts[i]
        a, b = shingles(t), shingles(t[: len(t) - len(t) // 3] + nxt[: len(t) // 3])
        assert r.near_edited == len(a & b) / len(a | b) and r.near_next == len(a & shingles(nxt)) / len(a | shingles(nxt))


def test_only_equal_sets_have_likeness_one(spark):
    long = prose(3, 120).split()
    texts = [" ".join(long)] + [" ".join([*long[:k], "changed", *long[k + 1 :]]) for k in range(len(long))] + [" ".join(long[:-1])]
    f = [r.fingerprint for r in fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert len(set(f)) == len(f) and likeness(f[0], f[0]) == 1.0
    for t, g in zip(texts[1:], f[1:]):
        a, b = shingles(texts[0]), shingles(t)
        assert likeness(f[0], g) < 1.0 and abs(likeness(f[0], g) - len(a & b) / len(a | b)) < 0.25
    assert merged(f[0], f[0]) == f[0] and 0.9 < likeness(merged(f[0], f[-1]), f[0]) < 1.0


def test_merged_short_texts_are_the_unions(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, "b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    f = {r.doc_id: r.fingerprint for r in fingerprints(df).collect()}
    assert merged(f[1], f[2]) == merged(f[2], f[1]) == merged(f[3], "0:") == f[3]
