"""Token ids in directly addressable codes: 8-bit chunk levels with continuation bitmaps and rank directories.

A shard holds whole documents. Level 0 has the low 8 bits of every id; a set bit in its
bitmap says that the id goes on in level 1, at the place given by the number of set bits
before it, and so on. That number is the rank directory's count up to the bit's block plus the
set bits inside the block, so any id is read with a few small reads and nothing is decoded
but what was asked for.

File, little-endian: ``GLDAC001``; u64 documents, ids, levels, block bits; u64 offsets of all
sections and of the end; then document ids (i64), their validity (u8), their first id (u64,
one more than documents); for each level: codes (u8), bitmap (bits, lowest first), rank
directory (u64 set bits before each block).
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.batches import frugal
from gridloom.llm.shared import ranged, running, scratch, stored, table
from gridloom.llm.tokenizing import BATCH_BYTES, encoder, plain_text, tokenizer_file

MAGIC = b"GLDAC001"
BLOCK = 512
#: Ids in a shard before the next one begins.
SHARD_IDS = 4_000_000


class DacWriter:
    """A shard as it grows: ids go to their levels at once, so two bytes are held for each code and nothing else of an id."""

    def __init__(self):
        self.keys, self.lens, self.n = [], [], 0
        self.codes, self.more = [bytearray()], [bytearray()]

    def add(self, doc_ids: list, lens: list[int], ids: np.ndarray) -> None:
        """Documents whose ids follow one another."""
        self.keys += doc_ids
        self.lens += lens
        self.n += len(ids)
        cur, level = ids, 0
        while len(cur):
            if level == len(self.codes):
                self.codes.append(bytearray())
                self.more.append(bytearray())
            more = cur > 255
            self.codes[level] += cur.astype("u1").data
            self.more[level] += more.data
            cur, level = cur[more] >> 8, level + 1

    def sections(self):
        """The file's parts in order, the header first."""
        starts = np.zeros(len(self.lens) + 1, "<u8")
        np.cumsum(self.lens, out=starts[1:])
        out = [np.array([0 if d is None else d for d in self.keys], "<i8").tobytes(), np.array([d is not None for d in self.keys], "u1").tobytes(), starts.tobytes()]
        for codes, more in zip(self.codes, self.more):
            padded = np.zeros(-(-max(len(more), 1) // BLOCK) * BLOCK, bool)
            padded[: len(more)] = np.frombuffer(more, bool)
            per_block = padded.reshape(-1, BLOCK).sum(1)
            out += [codes, np.packbits(padded, bitorder="little").tobytes(), (np.cumsum(per_block) - per_block).astype("<u8").tobytes()]
        head = len(MAGIC) + 8 * (4 + len(out) + 1)
        offsets = head + np.cumsum([0, *map(len, out)])
        return [MAGIC + struct.pack(f"<{4 + len(offsets)}Q", len(self.lens), self.n, len(self.codes), BLOCK, *offsets.tolist()), *out]


def dac_bytes(doc_ids: list, lens: list[int], ids: np.ndarray) -> bytes:
    """The file's content for documents whose ids follow one another."""
    w = DacWriter()
    w.add(doc_ids, lens, ids.astype(np.uint32))
    return b"".join(w.sections())


class DacReader:
    """Reads a shard through ``read(offset, length)``."""

    def __init__(self, read):
        self.read = read
        head = read(0, len(MAGIC) + 32)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token shard")
        self.n_docs, self.n_ids, self.levels, self.block = struct.unpack("<4Q", head[len(MAGIC) :])
        n = 3 + 3 * self.levels + 1
        self.at = struct.unpack(f"<{n}Q", read(len(MAGIC) + 32, 8 * n))

    def _section(self, k: int, dtype: str, a: int = 0, b: int | None = None) -> np.ndarray:
        size = np.dtype(dtype).itemsize
        start, end = self.at[k] + a * size, self.at[k + 1] if b is None else self.at[k] + b * size
        return np.frombuffer(self.read(start, end - start), dtype)

    def documents(self) -> tuple[list, np.ndarray]:
        """Document ids (None for null) and the places of their first ids."""
        ids, ok = self._section(0, "<i8"), self._section(1, "u1")
        return [int(d) if v else None for d, v in zip(ids, ok)], self._section(2, "<u8").astype(np.int64)

    def _bits(self, level: int, a: int, b: int) -> np.ndarray:
        return np.unpackbits(self._section(4 + 3 * level, "u1", a // 8, -(-b // 8)), bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)

    def _rank(self, level: int, i: int) -> int:
        block = i // self.block
        return int(self._section(5 + 3 * level, "<u8", block, block + 1)[0]) + int(self._bits(level, block * self.block, i).sum() if i % self.block else 0)

    def slice(self, a: int, b: int) -> np.ndarray:
        """Ids a to b."""
        if a >= b:
            return np.zeros(0, np.uint32)
        out = np.zeros(b - a, np.uint32)
        where, level = np.arange(b - a), 0
        while True:
            out[where] |= self._section(3 + 3 * level, "u1", a, b).astype(np.uint32) << np.uint32(8 * level)
            more = self._bits(level, a, b)
            where = where[more]
            if not len(where):
                return out
            a = self._rank(level, a)
            b, level = a + len(where), level + 1

    def access(self, i: int) -> int:
        """Id i alone."""
        return int(self.slice(i, i + 1)[0])


def opened(uri: str) -> DacReader:
    """A reader over a file in any store that pyarrow knows."""
    store, path = pafs.FileSystem.from_uri(uri)
    f = store.open_input_file(path)

    def read(offset, length):
        f.seek(offset)
        return f.read(length)

    return DacReader(read)


def put_file(uri: str, parts: list) -> None:
    """Write a whole file, of parts, under its final name only; a repeated task replaces it by the same bytes."""
    store, path = pafs.FileSystem.from_uri(uri)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(part) as f:
        for x in parts:
            f.write(x)
    store.move(part, path)


def write_token_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode all texts, append ``end_id`` to each and write shards in ascending key order.

    Returns the written table of shards: part, shard, uri, n_docs, n_ids; (part, shard) is the
    key order. Null texts count as empty, null keys come first, repeated keys stay (ordered by
    text), other columns are not carried; an empty table writes no shard.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(tokenizer_file(tokenizer))
    store, path = pafs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def write(batches):
        enc, part, shard, out = encoder(*held.value), TaskContext.get().partitionId(), 0, DacWriter()
        end = np.array([end_id], np.uint32)

        def flush():
            uri = f"{folder}/part-{part:06d}-{shard:05d}.dac"
            put_file(uri, out.sections())
            return pa.record_batch([pa.array([part]), pa.array([shard]), pa.array([uri]), pa.array([len(out.keys)]), pa.array([out.n])], ["part", "shard", "uri", "n_docs", "n_ids"])

        for b in frugal(batches, 1, BATCH_BYTES):
            for i, got in enc.groups(plain_text(b.column(1)), False):
                out.add(b.column(0).slice(i, len(got)).to_pylist(), [len(x) + 1 for x in got], np.concatenate([x for ids in got for x in (ids, end)]))
                if out.n >= SHARD_IDS:
                    yield flush()
                    out, shard = DacWriter(), shard + 1
        if out.keys:
            yield flush()

    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    dealt = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(*order)
    return stored(dealt.mapInArrow(write, "part long, shard long, uri string, n_docs long, n_ids long"), "token-shards")


def read_token_shards(shards: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each document in the shards: ``key``, start (ids of all documents before), n_tokens, ids_crc32."""
    placed = running(ranged(shards, ["part", "shard"]), ["part", "shard"], {"upto": F.col("n_ids")})

    def read(batches):
        for b in batches:
            for uri, first_id in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                r = opened(uri)
                docs, starts = r.documents()
                i = 0
                while i < r.n_docs:
                    j = max(i + 1, int(np.searchsorted(starts, starts[i] + 1_000_000, "right")) - 1)
                    ids = r.slice(int(starts[i]), int(starts[j])).astype("<u4")
                    at = starts[i : j + 1] - starts[i]
                    crc = [zlib.crc32(ids[a:z].tobytes()) for a, z in zip(at, at[1:])]
                    yield pa.record_batch([pa.array(docs[i:j], pa.int64()), pa.array(starts[i:j] + first_id), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    i = j

    tasks = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        placed.select("uri", (F.col("upto") - F.col("n_ids")).alias("first_id")).repartition(tasks, "uri")
        .mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
        .withColumnRenamed("doc_id", key)
    )


def token_file_rows(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs`` as token shards in the shared folder and read them back."""
    return read_token_shards(write_token_shards(docs, scratch(docs.sparkSession, "tokens"), tokenizer))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back."""
    import public_tokenizers

    return token_file_rows(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
