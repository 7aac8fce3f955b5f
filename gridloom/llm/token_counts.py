"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.batches import frugal
from gridloom.llm.shared import table
from gridloom.llm.tokenizing import BATCH_BYTES, encoder, plain_text, tokenizer_file


def token_counts(docs: DataFrame, tokenizer: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (``key``, n_bytes, n_tokens, over_limit), one for each row of ``docs``.

    ``tokenizer`` is the path of a ``.json`` (tokenizers) or ``.model`` (sentencepiece) file.
    Texts are encoded whole without added special tokens, truncation or padding; batches are
    balanced by bytes and long texts are cut only where no token can cross. A null text counts
    as empty, null and repeated keys stay as they are, other columns are not carried, an empty
    table gives an empty result. Only lengths leave the Python worker.
    """
    kind, content = tokenizer_file(tokenizer)
    held = docs.sparkSession.sparkContext.broadcast((kind, content))  # a tokenizer file, a few MB
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def count(batches):
        enc = encoder(*held.value)
        for b in frugal(batches, 1, BATCH_BYTES):
            texts = plain_text(b.column(1))
            yield pa.record_batch([b.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(enc.run(texts, True), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    got = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return got.select(F.col("doc_id").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op2_token_counts(spark, sf_dir):
    """Token counts of all documents."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 512)
