"""Personal data by weak supervision, with DataFrame operations only.

Patterns propose candidate spans; labelers (checksums, gazetteers, words before the span,
characters beside it, shape) vote for, against or not at all. Counts of vote patterns over the
whole corpus, at most a few hundred rows, are all that expectation-maximisation needs to
estimate how often each labeler votes how on personal data and on the rest. A logistic span
classifier is then fitted to the posteriors of the patterns, and scores every candidate in a
column expression. Base matches always stay; the classifier adds further candidates.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.shared import stored, table

KINDS = ("email", "ip", "card", "phone")
#: Kinds of added spans: those, and credentials.
ALL_KINDS = (*KINDS, "secret")
#: Base patterns. They match as the plain forms do, leftmost and non-overlapping, but in linear time: possessive
#: where nothing after could match the same characters, and never starting inside a run that failed.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further candidates: spelled-out addresses, IPv6, cards with other separators, national and 00 phone numbers, runs that mix letters and digits.
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]|\bat\b) ?[A-Za-z0-9-]++ ?(?:\(dot\)|\[dot\]|\bdot\b) ?[A-Za-z]{2,12}+(?![A-Za-z])",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:.])",
    "card": r"(?<![0-9])[0-9]{4}([./_\x{A0}])[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}(?![0-9])",
    "phone": r"(?<![0-9+().-])(?:00[1-9][0-9]{0,2}[\x20.-](?:[0-9]{2,4}[\x20.-]){1,3}[0-9]{2,4}(?![0-9])|(?:\([0-9]{3}\) ?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-]*[0-9]))",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+",
}
#: Gazetteers (fixed values): domain endings; words that announce a span of a kind; words that speak against one.
ENDINGS = ("com", "org", "net", "edu", "gov", "info", "io", "co", "de", "fr", "es", "it", "uk", "eu", "us", "ch", "at", "nl")
CUES = {
    "email": ("email", "e-mail", "mail", "contact", "write", "courriel", "correo", "kontakt"),
    "ip": ("ip", "host", "server", "address", "login", "adresse", "dirección"),
    "card": ("card", "visa", "mastercard", "pay", "credit", "carte", "karte", "tarjeta"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "fax", "cell", "telefon", "téléphone", "teléfono"),
    "secret": ("token", "password", "passwd", "pwd", "secret", "key", "apikey", "credential", "bearer", "auth", "passwort", "contraseña"),
}
#: Openings of credentials that are issued in a known form.
ISSUED = r"^(?:A[KS]IA[0-9A-Z]{16}$|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-|sk-[A-Za-z0-9]{20}|AIza[A-Za-z0-9_-]{35})"
AGAINST = ("version", "v", "isbn", "issn", "id", "no", "number", "page", "section", "release", "serial", "order")
VOTES = ("check", "gazetteer", "cue", "beside", "shape")
#: Accepted posterior of the classifier; EM and descent steps; share of votes that smoothing adds.
ACCEPT, EM_STEPS, FIT_STEPS, SMOOTH = 0.5, 60, 400, 1.0


def candidates(docs: DataFrame) -> DataFrame:
    """Candidates (doc_id, h, kind, base, start, end, span, before, after, good) of all distinct (doc_id, text).

    The text between matches comes from ``split``, the matches from ``regexp_extract_all``; their
    lengths, summed in order, are the positions in code points. ``good``: the kind's own test
    holds. Only texts with a candidate's necessary characters are searched.
    """
    digit = F.col("text").rlike("[0-9]")
    rows = docs.where(digit | F.contains("text", F.lit("@")) | F.lower("text").rlike(r"[(\[ ]dot[)\] ]"))

    def found(kind, base, needed):
        pattern = (BASE if base else LOOSE)[kind]
        gaps, spans = F.split("text", pattern, -1), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        return F.when(needed, F.transform(F.arrays_zip(spans.alias("s"), F.slice(gaps, 1, F.greatest(F.size(spans), F.lit(0))).alias("g"), F.slice(gaps, 2, F.greatest(F.size(spans), F.lit(0))).alias("z")), lambda x: F.struct(
            F.lit(kind).alias("kind"), F.lit(base).alias("base"), F.length(x["g"]).alias("gap"), x["s"].alias("span"),
            F.right(x["g"], F.lit(24)).alias("before"), F.left(x["z"], F.lit(2)).alias("after"))))

    lists = F.filter(F.array(
        found("email", True, F.contains("text", F.lit("@"))), found("ip", True, digit), found("card", True, digit & F.col("text").rlike("[0-9](?:[ -]?[0-9])")),
        found("phone", True, F.contains("text", F.lit("+"))), found("email", False, F.lower("text").rlike(r"[(\[ ]dot[)\] ]")), found("phone", False, F.col("text").rlike(r"[0-9]{3}[ .-][0-9]{4}|00[1-9][0-9]{0,2}[ .-]")),
        found("ip", False, F.col("text").rlike("(?:[0-9A-Fa-f]{1,4}:){7}")), found("card", False, F.col("text").rlike(r"[0-9]{4}[./_\x{A0}][0-9]{4}[./_\x{A0}][0-9]{4}")),
        found("secret", False, digit & F.col("text").rlike("[A-Za-z0-9+/_-]{16}")),
    ), lambda x: x.isNotNull() & (F.size(x) > 0))
    rows = rows.select("doc_id", "h", F.explode(lists).alias("l")).select("doc_id", "h", F.posexplode("l").alias("i", "m")).select("doc_id", "h", "i", "m.*").distinct()
    along = Window.partitionBy("doc_id", "h", "kind", "base").orderBy("i")
    end = F.sum(F.col("gap") + F.length("span")).over(along).cast("long")
    c = rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("span"))
    digits = F.regexp_replace("span", "[^0-9]", "")
    n = F.length(digits)
    luhn = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, k: acc + F.when((n - k) % 2 == 1, F.get(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.substring(digits, k, F.lit(1)).cast("int"))).otherwise(F.substring(digits, k, F.lit(1)).cast("int"))) % 10 == 0
    parts = F.forall(F.split("span", r"\."), lambda p: p.cast("double") <= 255)
    good = (
        F.when(F.col("kind") == "ip", F.when(F.col("base"), parts).otherwise(True))
        .when(F.col("kind") == "card", F.when(n.between(14, 19), luhn).otherwise(False))
        .when(F.col("kind") == "phone", n.between(10, 15)).otherwise(True)
    )
    return c.withColumn("good", F.coalesce(good, F.lit(False)))


def voted(c: DataFrame) -> DataFrame:
    """Candidates with a column for each labeler: 1 for personal data, -1 against, 0 for no vote."""
    word = F.lower(F.regexp_extract("before", r"([\p{L}-]+)[\s:.#=(<\"']*$", 1))
    kind, span = F.col("kind"), F.col("span")
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0).cast("int")
    digits = F.regexp_replace(span, "[^0-9]", "")
    check = F.when(kind.isin("ip", "card"), vote(F.col("good"), ~F.col("good"))).when(kind == "phone", vote(F.lit(False), ~F.col("good"))).otherwise(0)
    ending = F.lower(F.regexp_extract(span, r"([A-Za-z]+)$", 1)).isin(*ENDINGS)
    gazetteer = (
        F.when(kind == "email", vote(ending, ~ending))
        .when(kind == "card", vote(digits.rlike("^(?:4|5[1-5]|3[47]|6(?:011|5)|2[2-7])"), digits.rlike("^[0189]")))
        .when(kind == "secret", vote(span.rlike(ISSUED), F.lit(False)))
        .when(kind == "ip", vote(F.lit(False), span.rlike(r"^0+\."))).otherwise(0)
    )
    cue = F.lit(0)
    for k, words in CUES.items():
        cue = F.when((kind == k) & word.isin(*words), 1).otherwise(cue)
    cue = F.when(word.isin(*AGAINST), -1).otherwise(cue)
    apart = F.col("before").rlike(r"[\p{L}\p{N}_/&.]$") | F.col("after").rlike(r"^[\p{L}\p{N}_/=&@.]\p{L}")
    joined = F.col("before").rlike(r"[\p{L}\p{N}_/=&.]$") | F.col("after").rlike(r"^(?:[\p{L}\p{N}_/=&]|[.-][0-9])")
    shape = (
        F.when(kind == "card", vote(F.length(digits) == 16, ~F.length(digits).between(13, 19)))
        .when(kind == "phone", vote(span.rlike(r"[0-9()][ .-][0-9]{3}[ .-][0-9]{4}$"), F.length(digits) < 10))
        .when(kind == "secret", vote(span.rlike("(?:[A-Za-z]+[0-9]+){3}"), ~span.rlike("(?:[A-Za-z]+[0-9]+){2}|[0-9]+[A-Za-z]+[0-9]")))
        .when(kind == "email", vote(span.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]{1,63}(?:@|.*\W(?i:at)\W)"), F.length(span) > 254))
        .otherwise(vote(span.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$|:"), span.rlike("^[^:]*[0-9]{4}")))
    )
    return c.withColumns({"check": check.cast("int"), "gazetteer": gazetteer.cast("int"), "cue": cue.cast("int"), "beside": vote(F.lit(False), F.when(kind == "secret", apart).otherwise(joined)), "shape": shape.cast("int")})


def reliabilities(patterns: list[tuple], steps: int = EM_STEPS) -> tuple[dict, dict, list[float]]:
    """EM over (kind, votes, count): priors by kind, P(vote | class, it votes) by labeler, and each pattern's posterior.

    A labeler that doesn't vote says nothing: many vote on some kinds only, so silence tells kinds apart and not classes.
    """
    kinds = sorted({p[0] for p in patterns})
    prior = {k: 0.5 for k in kinds}
    j = len(VOTES)
    chance = {(i, v, c): (1.0 if v == 0 else 0.8 if (v > 0) == (c == 1) else 0.2) for i in range(j) for v in (-1, 0, 1) for c in (0, 1)}
    post = []
    for _ in range(steps):
        post = []
        for kind, votes, _n in patterns:
            a, b = math.log(prior[kind]), math.log(1 - prior[kind])
            for i, v in enumerate(votes):
                a += math.log(chance[i, v, 1])
                b += math.log(chance[i, v, 0])
            post.append(1 / (1 + math.exp(max(-60.0, min(60.0, b - a)))))
        for k in kinds:
            n = sum(p[2] for p in patterns if p[0] == k)
            prior[k] = (sum(p[2] * q for p, q in zip(patterns, post) if p[0] == k) + SMOOTH) / (n + 2 * SMOOTH)
        for i in range(j):
            for c in (0, 1):
                # smoothing towards a labeler that is right four times as often as wrong
                mass = {v: SMOOTH * (0.8 if (v > 0) == (c == 1) else 0.2) for v in (-1, 1)}
                for (kind, votes, n), q in zip(patterns, post):
                    if votes[i]:
                        mass[votes[i]] += n * (q if c else 1 - q)
                total = sum(mass.values())
                for v, m in mass.items():
                    chance[i, v, c] = m / total
    return prior, chance, post


def _features(kind: str, votes: tuple) -> list[float]:
    return [1.0, *(float(kind == k) for k in ALL_KINDS), *(float(v > 0) for v in votes), *(float(v < 0) for v in votes)]


def fitted(patterns: list[tuple], post: list[float], steps: int = FIT_STEPS) -> list[float]:
    """Weights of a logistic classifier on the patterns' posteriors, by accelerated gradient descent."""
    rows = [(_features(k, v), n, q) for (k, v, n), q in zip(patterns, post)]
    total = sum(n for _, n, _ in rows) or 1
    w = [0.0] * len(_features(ALL_KINDS[0], (0,) * len(VOTES)))
    speed = [0.0] * len(w)
    for _ in range(steps):
        grad = [1e-4 * x for x in w]
        for x, n, q in rows:
            p = 1 / (1 + math.exp(max(-60.0, min(60.0, -sum(a * b for a, b in zip(w, x))))))
            for i, a in enumerate(x):
                if a:
                    grad[i] += n / total * (p - q) * a
        speed = [0.9 * s - 0.5 * g for s, g in zip(speed, grad)]
        w = [a + s for a, s in zip(w, speed)]
    return w


def labeler_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (labeler, kind, vote, on_personal, on_rest): how often, by EM, each labeler that votes does so how; and the share of personal data for each kind (labeler null)."""
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    prior, chance, _ = reliabilities(_patterns(voted(candidates(d))))
    rows = [(None, k, None, p, 1 - p) for k, p in prior.items()] + [(n, None, v, chance[i, v, 1], chance[i, v, 0]) for i, n in enumerate(VOTES) for v in (-1, 1)]
    return docs.sparkSession.createDataFrame(rows, "labeler string, kind string, vote int, on_personal double, on_rest double")


def _patterns(votes: DataFrame) -> list[tuple]:
    rows = votes.groupBy("kind", *VOTES).agg(F.count("*").alias("n")).collect()
    return sorted((r["kind"], tuple(r[v] for v in VOTES), r["n"]) for r in rows)


def classifier(votes: DataFrame) -> list[float]:
    """The span classifier's weights, from the vote patterns of all candidates (at most 5 x 3^5 rows)."""
    patterns = _patterns(votes)
    _, _, post = reliabilities(patterns)
    return fitted(patterns, post)


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", accept: float = ACCEPT) -> DataFrame:
    """Rows (``key``, n_email, n_ip, n_card, n_phone, base_sha256, spans), one for each row of ``docs``.

    Counts and digest are of the base matches; ``spans`` has all, ``kind:start:end`` by start, then
    kind. Added spans (the four kinds and ``secret``) are those that some labeler votes for and the classifier accepts; they never overlap base ones. Null texts count as empty; rows of one key with
    different texts are told apart by a hash of the text, equal rows get equal results; null keys
    stay. Other columns are not carried; an empty table gives an empty result.
    """
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    c = stored(voted(candidates(d)).drop("gap", "before", "after", "i"), "pii-candidates")
    w = classifier(c)
    names = [None, *ALL_KINDS, *VOTES, *VOTES]
    score = F.lit(w[0])
    for i, x in enumerate(w[1:], 1):
        on = F.col("kind") == names[i] if i <= len(ALL_KINDS) else (F.col(names[i]) == (1 if i <= len(ALL_KINDS) + len(VOTES) else -1))
        score = score + F.when(on, F.lit(x)).otherwise(0.0)
    order = F.array_position(F.array(*map(F.lit, ALL_KINDS)), F.col("kind"))
    c = c.withColumn("kept", F.col("base") & F.col("good")).withColumn("p", 1 / (1 + F.exp(-score))).withColumn("o", order)
    # further candidates beside all base spans of the document
    here = Window.partitionBy("doc_id", "h").orderBy("start", "end", "o", "base")
    before = F.max(F.when(F.col("kept"), F.col("end"))).over(here.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("kept"), F.col("start"))).over(here.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    c = c.withColumn("added", ~F.col("base") & F.col("good") & (F.greatest(*VOTES) > 0) & (F.col("p") >= accept) & free).where("kept or added")
    span = F.struct("start", "o", F.concat_ws(":", "kind", "start", "end").alias("s"))
    listed = lambda x: F.array_join(F.transform(F.array_sort(x), lambda y: y["s"]), ",")
    per = c.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("x")).agg(
        *(F.count(F.when(F.col("kept") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS),
        listed(F.collect_list(F.when(F.col("kept"), span))).alias("base"), listed(F.collect_list(span)).alias("spans"),
    )
    out = d.select("doc_id", "h").join(per, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("x")), "left")
    zero = F.lit(0).cast("long")
    return out.select(F.col("doc_id").alias(key), *(F.coalesce(f"n_{k}", zero).alias(f"n_{k}") for k in KINDS), F.sha2(F.encode(F.coalesce("base", F.lit("")), "UTF-8"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents."""
    return personal_data(table(spark, sf_dir, "documents"))
