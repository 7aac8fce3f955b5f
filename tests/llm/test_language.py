import math
import random
import re
from collections import Counter

from gridloom.llm.language_id import BUCKETS, EVIDENCE, GRAMS, SMOOTH, held_out, identify, train

SYLLABLES = {"xx": ["ka", "to", "ri", "mu"], "yy": ["sch", "ber", "ung", "ö"], "zz": ["льо", "ни", "ка", "да"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang, rng.randint(3, 60)), lang, "clash") for i, lang in enumerate(random.Random(2).choices(sorted(SYLLABLES), k=400))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    got = {r.doc_id: r for r in identify(df, train(df.where(~held_out()))).collect()}
    out = {r.doc_id for r in df.where(held_out()).collect()}
    assert 60 < len(out) < 140 and all(0 <= r.score <= 1 for r in got.values())
    assert sum(got[d].lang_pred == lang for d, _, lang, _ in rows if d in out) >= 0.98 * len(out)


def test_undetermined_nulls_long_and_empty(spark):
    df = spark.createDataFrame([(1, "kato rimu", "xx"), (2, "berung", "yy"), (3, None, "xx"), (4, "", None), (5, "12 !? 34", "yy"), (6, "kato " * 300_000, None), (1, "kato rimu", "xx"), (None, "kato", None)], "doc_id long, text string, lang string")
    model = train(df)
    got = [(r.doc_id, r.lang_pred, r.score) for r in identify(df, model).collect()]
    assert {(d, p) for d, p, _ in got} == {(1, "xx"), (2, "yy"), (3, "und"), (4, "und"), (5, "und"), (6, "xx"), (None, "xx")} and len(got) == 8
    assert all(s == 0 for _, p, s in got if p == "und")
    assert identify(df.where("false"), model).count() == 0
    assert {r.lang_pred for r in identify(df, train(df.where("false"))).collect()} == {"und"}


def plain_grams(text):
    """Buckets of a text's n-grams, by whole numbers and strings."""
    clean = " " + re.sub(r"[^a-zà-öø-ÿа-я]+", " ", (text or "").lower()) + " "
    for n in range(1, GRAMS + 1):
        for i in range(len(clean) - n + 1):
            g = clean[i : i + n]
            if g[:2].strip():
                h = 0
                for k, c in enumerate(g, 1):
                    h = (h * 0x9E3779B97F4A7C15 + ord(c) + k) % (1 << 64)
                h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 % (1 << 64)
                yield h >> 64 - BUCKETS.bit_length() + 1


def test_counts_and_posteriors_against_plain_python(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.choice(["xx", "yy", "zz"]), rng.randint(1, 9)) + rng.choice(["", " - 7", " ka"]), rng.choice(["xx", "yy", "zz", None])) for i in range(60)]
    rows += [(98, "  ", "xx"), (99, None, "yy")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    names, logs = train(df)
    counts = {x: Counter(g for _, t, lang in rows if lang == x for g in plain_grams(t)) for x in names}
    assert names == ["xx", "yy", "zz"]
    chance = lambda x, g: math.log((counts[x][g] + SMOOTH) / (counts[x].total() + SMOOTH * BUCKETS))
    assert all(abs(logs[i, g] - chance(x, g)) < 1e-5 for i, x in enumerate(names) for g in (*counts["xx"], 0, BUCKETS - 1))
    got = {r.doc_id: r for r in identify(df, (names, logs)).collect()}
    for d, t, _ in rows:
        grams = list(plain_grams(t))
        if not grams:
            assert (got[d].lang_pred, got[d].score) == ("und", 0.0)
            continue
        mean = [sum(chance(x, g) for g in grams) / len(grams) * min(len(grams), EVIDENCE) for x in names]
        share = [1 / sum(math.exp(m - best) for m in mean) for best in mean]
        assert got[d].lang_pred == names[share.index(max(share))] and abs(got[d].score - max(share)) < 1e-4
    assert len({round(r.score, 2) for r in got.values()}) > 5
