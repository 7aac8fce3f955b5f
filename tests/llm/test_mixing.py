import random

import pytest

from gridloom.llm.mixing import mix


def targets(sizes, weights=(1, 2, 3), cap=3):
    """Shares by weight, again and again until nothing is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, free = sum(sizes.values()), {}, set(names)
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > cap * sizes[s] + 1e-9]
        if not over:
            out |= {s: left * w[s] / total for s in free}
            break
        for s in over:
            out[s] = cap * sizes[s]
            left -= cap * sizes[s]
            free.discard(s)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_totals_and_caps(spark, seed):
    rng = random.Random(seed)
    rows = []
    for s, n in [("a", 700), ("b", 30), ("c", 4), ("é", 300), (None, 200), ("B", 1)]:
        rows += [(len(rows) + i, "w " * int(rng.paretovariate(1.2) * 10 % 400), s, 1.5) for i in range(n)]
    rows += [(10_000, None, "a", 1.5), (10_001, "  ", "empty", 1.5), (10_002, "x " * 50, "a", 1.5), (10_002, "x " * 50, "a", 1.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target double").repartition(4)
    first, again = (sorted(map(tuple, mix(df).collect()), key=str) for _ in range(2))
    assert first == again and len(first) == len(rows)
    source = {r[0]: r[2] for r in rows}
    size, taken, want = {}, {}, {}
    for d, n, total, target, copies, t in first:
        s = source[d]
        size[s], taken[s], want[s] = size.get(s, 0) + n, taken.get(s, 0) + t, target
        assert 0 <= copies <= 3 and t == copies * n
    expected = targets(size)
    for s, n in size.items():
        assert want[s] == pytest.approx(expected[s], rel=1e-9, abs=1e-9)
        longest = max(r[1] for r in first if source[r[0]] == s)
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], 0.75 * longest if n < 5000 else 0)


def test_empty(spark):
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_one_document_and_no_words(spark):
    got = mix(spark.createDataFrame([(1, "a b c", "s"), (None, None, None)], "doc_id long, text string, source string")).collect()
    assert {(r.doc_id, r.size, r.taken) for r in got} == {(1, 3, 3), (None, 0, 0)}
