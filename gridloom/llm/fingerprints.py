"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the range is kept.

As membership of a hash in a sketch doesn't depend on the document, the sketch of a union is the
union of sketches, and the share of one sketch inside another estimates containment however
unequal the documents are. A fingerprint is ``count:codes``: the number of distinct shingles,
and the kept hashes (48 bits each, ascending) in base64. A small set keeps all its hashes, so
short texts are told apart and compared exactly; a larger one ends with a digest of all its hashes,
in the upper half of the range, where none is kept. Functions of two fingerprints take the scale that both were made with.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.batches import frugal
from gridloom.llm.shared import table
from gridloom.llm.shingles import shingle_hashes
from gridloom.llm.tokenizing import plain_text

#: One in so many hashes is kept.
SCALE = 4
#: Sets of up to so many times the scale are kept whole, so what is estimated rests on about as many kept hashes or more.
WHOLE = 16
_CODES, _UPPER = 1 << 48, 1 << 47
_LEAST = -(1 << 63)


def _kept(codes: np.ndarray, scale: int) -> np.ndarray:
    return codes[: np.searchsorted(codes, np.uint64(_CODES // scale))]


def _digest(data: bytes) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "big") % _UPPER + _UPPER], np.uint64)


def _reduced(codes: np.ndarray, scale: int) -> tuple[int, np.ndarray]:
    kept = _kept(codes, scale)
    if len(codes) <= max(WHOLE * scale, len(kept) + 1):
        return len(codes), codes
    return len(codes), np.concatenate([kept, _digest(codes.astype(">u8").tobytes())])


def sketch(hashes: np.ndarray, scale: int = SCALE) -> tuple[int, np.ndarray]:
    """Number of distinct shingles, and their sorted distinct 48-bit codes: of a small set all, else those below the threshold and the digest."""
    return _reduced(np.unique(hashes >> np.uint64(16)), scale)


def encoded(count: int, codes: np.ndarray) -> str:
    """The fingerprint of a sketch."""
    raw = codes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
    return f"{count}:{base64.b64encode(raw.tobytes()).decode()}"


def decoded(fingerprint: str) -> tuple[int, np.ndarray]:
    """The sketch of a fingerprint."""
    count, _, codes = fingerprint.partition(":")
    raw = np.frombuffer(base64.b64decode(codes), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 2:] = raw
    return int(count), wide.reshape(-1).view(">u8").astype(np.uint64)


def _alike(x: np.ndarray, y: np.ndarray) -> bool:
    return len(x) == len(y) and bool((x == y).all())


def _comparable(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray], scale: int) -> tuple[bool, np.ndarray, np.ndarray]:
    """Whether both sets are whole, and their codes; else the codes below the threshold."""
    whole = all(n == len(codes) for n, codes in (a, b))
    return (True, a[1], b[1]) if whole else (False, _kept(a[1], scale), _kept(b[1], scale))


def merged(a: str, b: str, scale: int = SCALE) -> str:
    """A fingerprint for the union of two documents' shingles.

    That of the union itself where both sets are whole or equal; else its count is estimated and its digest is of the
    two fingerprints, so it equals no text's.
    """
    (n, p), (m, q) = decoded(a), decoded(b)
    whole, x, y = _comparable((n, p), (m, q), scale)
    both = np.union1d(x, y)
    if whole:
        return encoded(*_reduced(both, scale))
    if a == b:
        return a
    shared = len(x) + len(y) - len(both)
    count = n + m - (round(n * shared / len(x)) if len(x) else 0)
    return encoded(max(count, n, m, len(both) + 2), np.concatenate([both, _digest(" ".join(sorted((a, b))).encode())]))


def containment(a: str, b: str, scale: int = SCALE) -> float:
    """Share of a's shingles that b has, estimated unless both sets are whole; 0 if none of a's can be compared."""
    _, x, y = _comparable(decoded(a), decoded(b), scale)
    return len(np.intersect1d(x, y, assume_unique=True)) / len(x) if len(x) else 0.0


def _likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray], scale: int = SCALE) -> float:
    n, m = sorted((a[0], b[0]))
    if n == m and _alike(a[1], b[1]):
        return 1.0
    whole, x, y = _comparable(a, b, scale)
    shared = len(np.intersect1d(x, y, assume_unique=True))
    union = len(x) + len(y) - shared
    # sets that differ are no more alike than their sizes allow
    return min(shared / union if union else 0.0, 1.0 if whole else n / m if n < m else (n - 1) / (n + 1))


def likeness(a: str, b: str, scale: int = SCALE) -> float:
    """Jaccard similarity, exact if both sets are whole, else estimated; 1 for equal fingerprints only, which equal sets have."""
    return _likeness(decoded(a), decoded(b), scale)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", scale: int = SCALE) -> DataFrame:
    """Rows (``key``, fingerprint), one for each row; null texts count as empty ("0:"), other columns are not carried."""

    def run(batches):
        for b in frugal(batches, 1):
            yield pa.record_batch([b.column(0), pa.array([encoded(*sketch(h, scale)) for h in shingle_hashes(plain_text(b.column(1)))], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fingerprint string").withColumnRenamed("doc_id", key)


def beside_next(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text) dealt by ranges of doc_id, in descending order with the next row's copy at the end of each range.

    Columns: part, halo (1 for the copy), rank (doc_id, the least long for null), doc_id, text. Ranges
    are cut at quantiles of doc_id; the driver sees one number for each range. After the last
    row comes the first. Rows of one doc_id are ordered by text.
    """
    spark = docs.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.withColumn("rank", F.coalesce("doc_id", F.lit(_LEAST)))
    cuts = sorted({int(x) for x in docs.approxQuantile("rank", [k / n for k in range(1, n)], 0.2 / n)})
    part = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c <= F.col("rank"))) if cuts else F.lit(0)
    docs = docs.withColumn("part", part)
    tops = sorted(docs.groupBy("part").agg(F.max("rank")).collect(), reverse=True)  # a row for each range
    send = [(nxt[1], here[0]) for here, nxt in zip(tops, tops[1:] + tops[:1])]
    halo = spark.createDataFrame(send, "rank long, also int")
    both = F.filter(F.array(F.struct(F.col("part"), F.lit(0).alias("halo")), F.struct(F.col("also").alias("part"), F.lit(1).alias("halo"))), lambda x: x["part"].isNotNull())
    dealt = docs.join(F.broadcast(halo), "rank", "left").select(F.explode(both).alias("at"), "rank", "doc_id", "text").select("at.part", "at.halo", "rank", "doc_id", "text")
    return dealt.repartition(n // 4, "part").sortWithinPartitions("part", "halo", F.col("rank").desc(), F.col("text").asc_nulls_first())


def fingerprints_beside_next(docs: DataFrame, key: str = "doc_id", text: str = "text", scale: int = SCALE) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, with likenesses.

    The edited text has its last third of code points replaced by the first as many (or all) of
    the next row's text in descending key order (null keys last, rows of one key by text; after the
    last comes the first). Returns one row for each row: ``key``, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next. Null texts count as empty, a single
    row is next to itself, other columns are not carried, an empty table gives an empty result.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        held = None  # the row before this batch: part, doc_id, text, sketch
        for b in frugal(batches, 4):
            texts = plain_text(b.column(4))
            own = [sketch(h, scale) for h in shingle_hashes(texts)]
            rows = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), texts.to_pylist(), own))
            pairs = [(x, y) for x, y in zip(([held] if held else []) + rows, rows if held else rows[1:]) if x[1] == 0 and x[0] == y[0]]
            held = rows[-1] if rows else held
            if not pairs:
                continue
            edited = [x[3][: len(x[3]) - len(x[3]) // 3] + y[3][: len(x[3]) // 3] for x, y in pairs]
            sketches = [sketch(h, scale) for h in shingle_hashes(pa.array(edited, pa.large_string()))]
            yield pa.record_batch([
                pa.array([x[2] for x, _ in pairs], pa.int64()), pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]), pa.array([encoded(*x[4]) for x, _ in pairs]), pa.array([encoded(*e) for e in sketches]),
                pa.array([_likeness(x[4], e, scale) for (x, _), e in zip(pairs, sketches)], pa.float64()), pa.array([_likeness(x[4], y[4], scale) for x, y in pairs], pa.float64()),
            ], names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return beside_next(rows).mapInArrow(run, schema).withColumnRenamed("doc_id", key)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts."""
    return fingerprints_beside_next(table(spark, sf_dir, "documents"))
