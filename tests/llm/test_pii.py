import hashlib
import random

from gridloom.llm.pii import ALL_KINDS, KINDS, VOTES, fitted, labeler_report, personal_data, reliabilities
from tests.llm import brute

PARTS = ["1", "12", "255", "300", ".", "@", "a", "b.c", "-", " ", "+", "+1 (", "4", "4111111111111111", "é", "😀", "\n", "x%y", "a@b.c", "1.2.3.4", "5500 0000 0000 0004"]


def checked(rows, texts):
    for r in rows:
        spans = brute.personal(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert hashlib.sha256(joined.encode()).hexdigest() == r.base_sha256, texts[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[3] == k for s in spans) for k in KINDS]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_base_spans_against_plain_patterns(spark):
    random.seed(2)
    texts = ["".join(random.choice(PARTS) for _ in range(random.randint(0, 25))) for _ in range(1500)] + [None, "", "1" * 30_000, "a." * 3000 + "@b.c", "1." * 5000, "+" + "1" * 3000]
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    rows = personal_data(df).collect()
    assert len(rows) == len(texts)
    checked(rows, texts)


def test_long_runs_stay_linear(spark):
    text = "a" * 3_000_000 + " " + "9" * 3_000_000
    row = personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.spans == "" and row.n_email == 0


def test_added_spans_stay_off_base_ones_and_clean_texts(spark):
    texts = {1: "call (743) 555-3824 now", 2: "write to jane at example dot com", 3: "mail jane@example.com or tel +1 (743) 555-3824", 4: "meet at noon, 4000 people and 12 dogs in 1984-1990", 5: "version 1.2.3.400"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in personal_data(df).collect()}
    checked(got.values(), texts)
    assert got[1].spans == "phone:5:19" and got[2].spans == "email:9:32"
    assert got[3].spans == "email:5:21,phone:29:46" and got[4].spans == "" and got[5].spans == ""


def test_repeated_and_null_keys_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a@b.c"), (1, "a@b.c"), (1, "none"), (None, "a@b.c")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_email) for r in personal_data(df).collect()) == [("1", 0), ("1", 1), ("1", 1), ("None", 1)]
    assert personal_data(df.where("false")).count() == 0


def test_em_finds_reliable_labelers():
    """Votes drawn from known reliabilities: the estimates order the labelers and the posteriors the classes."""
    rng = random.Random(0)
    right = [0.95, 0.9, 0.6, 0.8, 0.55]
    counts, truth = {}, {}
    for _ in range(4000):
        y = rng.random() < 0.4
        votes = tuple((1 if (rng.random() < p) == y else -1) if rng.random() < 0.9 else 0 for p in right)
        counts["card", votes] = counts.get(("card", votes), 0) + 1
        truth.setdefault(votes, []).append(y)
    patterns = [(k, v, n) for (k, v), n in sorted(counts.items())]
    prior, chance, post = reliabilities(patterns)
    assert abs(prior["card"] - 0.4) < 0.1 and len(right) == len(VOTES)
    assert chance[0, 1, 1] > chance[2, 1, 1] > chance[4, 1, 1] - 0.05
    good = sum(sum(t == (q > 0.5) for t in truth[v]) for (_, v, _), q in zip(patterns, post))
    assert good / 4000 > 0.9
    assert len(fitted(patterns, post)) == 1 + len(ALL_KINDS) + 2 * len(VOTES)


def test_precision_and_recall_of_added_spans(spark):
    """Planted spans that no base pattern finds, among decoys of the same looks."""
    rng = random.Random(3)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    upper = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(n))
    num = lambda n: "".join(rng.choice("123456789") for _ in range(n))

    def card():
        d = "4" + num(14)
        return next(f"{x[:4]}.{x[4:8]}.{x[8:12]}.{x[12:]}" for x in (d + str(k) for k in range(10)) if brute.luhn(x))

    plant = [
        ("secret", lambda: ('token = "', hexa(40), '" is set')), ("secret", lambda: ("password=", hexa(18), " was")), ("secret", lambda: ("use ", "AKIA" + upper(16), " here")),
        ("phone", lambda: ("call ", f"({num(3)}) 555-{num(4)}", " now")), ("phone", lambda: ("mobile: ", f"{num(3)}-555-{num(4)}", ".")),
        ("email", lambda: ("write to ", f"jo{num(2)} at mail dot com", " soon")), ("card", lambda: ("card ", card(), " paid")),
        ("ip", lambda: ("host ", ":".join(hexa(4) for _ in range(8)), " up")),
    ]
    decoys = [lambda: f"version 1.{num(2)}.{num(3)}.4000", lambda: f"isbn {num(13)}", lambda: "chapter" + num(12), lambda: "some-long-name-of-a-file-2024", lambda: f"{num(4)}.{num(4)}.{num(4)}.{num(3)}1", lambda: f"on 2024-05-1{num(1)} at noon", lambda: "supercalifragilistic words", lambda: f"order {num(16)}"]
    texts, want = {}, {}
    for i in range(400):
        words = ["lorem", "ipsum", "dolor"] * rng.randint(1, 4)
        if i % 2:
            kind, make = rng.choice(plant)
            lead, span, tail = make()
            at = len(" ".join(words)) + 1 + len(lead)
            want[i] = {f"{kind}:{at}:{at + len(span)}"}
            words.append(lead + span + tail)
        else:
            words.append(rng.choice(decoys)())
        texts[i] = " ".join(words)
    rows = personal_data(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    checked(rows, texts)
    base = {r.doc_id: {f"{k}:{a}:{b}" for a, _, b, k in brute.personal(texts[r.doc_id])} for r in rows}
    added = {r.doc_id: set(filter(None, r.spans.split(","))) - base[r.doc_id] for r in rows}
    right = sum(len(added[i] & want.get(i, set())) for i in texts)
    precision, recall = right / max(1, sum(map(len, added.values()))), right / len(want)
    wrong = [texts[i][int(x.split(":")[1]) - 12 :] for i in texts for x in added[i] - want.get(i, set())]
    assert precision >= 0.95 and recall >= 0.9, (precision, recall, wrong[:20], [texts[i] for i in want if not want[i] & added[i]][:5])


def test_report_of_the_labelers(spark):
    texts = [f"password={k:09x}a1b2c3d4e5 and mail a{k}@b.com" for k in range(30)] + ["chapter123456789012", "none"]
    rows = labeler_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    cue = {r.vote: r for r in rows if r.labeler == "cue"}
    assert cue[1].on_personal > cue[1].on_rest and {"email", "secret"} <= {r.kind for r in rows if r.labeler is None}
