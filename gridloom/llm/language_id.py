"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, its characters that are no letters become single spaces, and the n-grams of
one to four characters are hashed into a fixed number of buckets. Training counts buckets for each
language where the text is; only sums are shuffled. The matrix of log-probabilities (languages x
buckets) is broadcast, and a batch is scored with numpy as a sparse product. A document's
score is the posterior of the chosen language where the mean log-likelihood of its n-grams counts as
often as EVIDENCE n-grams, or all of a shorter text's: n-grams overlap, so all of them would be far too
sure, and EVIDENCE is as small as keeps scores of mixed and short texts apart from those of plain ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.llm.batches import frugal
from gridloom.llm.shared import table
from gridloom.llm.tokenizing import plain_text

BUCKETS, GRAMS, SMOOTH, EVIDENCE = 1 << 15, 4, 0.5, 2.0
#: Languages that a model holds at most, so that its matrix stays under 130 MB.
MOST_LANGUAGES = 1000
_GROUP_CHARS = 1 << 19


def _letters(texts: pa.Array):
    """For groups of texts: code points with single spaces for what is no letter, each text led and closed by a space; and each character's text."""
    low = pc.utf8_lower(texts.cast(pa.large_string()))
    clean = pc.replace_substring_regex(low, r"\PL+", " ")
    size = pc.utf8_length(clean).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    group = (np.cumsum(size) - size) // _GROUP_CHARS
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        text = "".join(f" {t} " for t in clean.slice(a, b - a).to_pylist())
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        owner = np.repeat(np.arange(a, b), size[a:b])
        yield a, b, chars, owner


def _grams(chars: np.ndarray, owner: np.ndarray):
    """Buckets of all n-grams that lie in one text and are no space alone, with their texts."""
    blank = chars == 32
    h = np.zeros(len(chars), np.uint64)
    for n in range(1, GRAMS + 1):
        if len(chars) < n:
            return
        h = h[: len(chars) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + chars[n - 1 :].astype(np.uint64) + np.uint64(n)
        ok = owner[n - 1 :] == owner[: len(owner) - n + 1]
        ok &= ~blank[: len(ok)] if n == 1 else ~(blank[: len(ok)] & blank[1 : len(ok) + 1])
        x = h[ok]
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        yield (x >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), owner[: len(ok)][ok]


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities (languages x BUCKETS, float32) from all rows with a language.

    Null texts and languages take no part; more than MOST_LANGUAGES languages are an error. The driver gets one packed
    row of log-probabilities for each language.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))

    def count(batches):
        sums: dict = {}
        for b in frugal(batches, 0):
            names = b.column(1).to_pylist()
            seen = {x: i for i, x in enumerate(dict.fromkeys(names))}
            of = np.array([seen[x] for x in names])
            table_ = np.zeros((len(seen), BUCKETS), np.int64)
            for _, _, chars, owner in _letters(plain_text(b.column(0))):
                for bucket, doc in _grams(chars, owner):
                    table_ += np.bincount(of[doc] * BUCKETS + bucket, minlength=table_.size).reshape(table_.shape)
            for x, i in seen.items():
                sums[x] = sums.get(x, 0) + table_[i]
        for x, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.record_batch([pa.array([x] * len(at), pa.string()), pa.array(at), pa.array(c[at])], ["lang", "bucket", "k"])

    def log_probabilities(batches):
        held, name = None, None
        for b in batches:
            names, buckets, k = b.column(0).to_pylist(), b.column(1).to_numpy(), b.column(2).to_numpy()
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for x, z in zip(cuts, cuts[1:]):
                if x < z and names[x] != name:
                    if held is not None:
                        yield packed(name, held)
                    name, held = names[x], np.full(BUCKETS, SMOOTH)
                held[buckets[x:z]] += k[x:z]
        if held is not None:
            yield packed(name, held)

    def packed(name, counts):
        return pa.record_batch([pa.array([name], pa.string()), pa.array([np.log(counts / counts.sum()).astype("<f4").tobytes()], pa.binary())], ["lang", "logs"])

    tasks = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    got = rows.mapInArrow(count, "lang string, bucket long, k long").groupBy("lang", "bucket").agg(F.sum("k").alias("k"))
    # a row of 128 KB for each language: the bound on languages holds before anything comes to the driver
    rows = got.repartition(tasks, "lang").sortWithinPartitions("lang").mapInArrow(log_probabilities, "lang string, logs binary")
    found = sorted(rows.limit(MOST_LANGUAGES + 1).collect(), key=lambda r: r["lang"])
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    logs = np.frombuffer(b"".join(r["logs"] for r in found), "<f4").reshape(len(found), BUCKETS)
    return [r["lang"] for r in found], logs


def _scored(texts: pa.Array, names: list[str], logs: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """For each text its language, its score, and whether it has a letter; logs: buckets x languages."""
    total = np.zeros((len(texts), max(len(names), 1)))
    count = np.zeros(len(texts))
    for a, z, chars, owner in _letters(plain_text(texts)):
        for bucket, doc in _grams(chars, owner):
            count[a:z] += np.bincount(doc - a, minlength=z - a)
            for i in range(len(names)):
                total[a:z, i] += np.bincount(doc - a, weights=logs[bucket, i], minlength=z - a)
    mean = total / np.maximum(count, 1)[:, None] * np.minimum(count, EVIDENCE)[:, None]
    post = np.exp(mean - mean.max(1, keepdims=True))
    post /= post.sum(1, keepdims=True)
    best = post.argmax(1)
    some = (count > 0) & bool(names)
    pred = [names[i] if s else "und" for i, s in zip(best, some)]
    return pa.array(pred, pa.string()), pa.array(np.where(some, post[np.arange(len(best)), best], 0.0)), pa.array(count > 0)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (``key``, lang_pred, score), one for each row of ``docs``.

    ``und`` with score 0 if the text is null or has no letter, or the model has no language. Ties go
    to the first language by name. Other columns are not carried.
    """
    names, logs = model
    held = docs.sparkSession.sparkContext.broadcast((names, np.ascontiguousarray(logs.T)))  # at most MOST_LANGUAGES x BUCKETS floats

    def run(batches):
        names, logs = held.value
        for b in frugal(batches, 1):
            pred, score, _ = _scored(b.column(1), names, logs)
            yield pa.record_batch([b.column(0), pred, score], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double").withColumnRenamed("doc_id", key)


def identified(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score as ``identify`` gives them, and lettered: whether the text has a letter.

    All columns are carried, so rows need no key; none may have one of the new names.
    """
    names, logs = model
    held = docs.sparkSession.sparkContext.broadcast((names, np.ascontiguousarray(logs.T)))
    at = docs.columns.index(text)
    schema = StructType([*docs.schema.fields, *StructType.fromDDL("lang_pred string, score double, lettered boolean").fields])

    def run(batches):
        names, logs = held.value
        for b in frugal(batches, at):
            yield pa.record_batch([*b.columns, *_scored(b.column(at), names, logs)], schema.names)

    return docs.mapInArrow(run, schema)


def held_out(key: str = "doc_id"):
    """Whether a row is kept out of training: crc32 of its key as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learnt from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    got = identify(docs, train(docs.where(~held_out())))
    return got.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
