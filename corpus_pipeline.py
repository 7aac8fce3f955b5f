"""The corpus pipeline: each stage takes the documents that its predecessor kept.

Language identification drops what it can't name a language for; of each group of near-duplicates
by n-gram Jaccard similarity the smallest doc_id stays; documents with benchmark passages go;
sources are mixed to their target weights, a document as often as it is taken; the rest is written
as token files and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.decontaminate import contamination
from gridloom.llm.jaccard_join import jaccard_components
from gridloom.llm.language_id import held_out, identified, train
from gridloom.llm.mixing import mix
from gridloom.llm.shared import sized, stored, table
from gridloom.llm.token_output import token_file_rows

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of each row, ``row``: doc_id, or where one is null or repeated a number made here.

    These numbers are in the order of doc_id (nulls last) and, within one, of a hash of the text.
    """
    if not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count():
        return docs.withColumn("row", F.col("doc_id"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("h")]
    dealt = docs.withColumn("h", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order, "text", "lang", "source", "n_chars")
    return stored(dealt.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "rows")


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """What ``rows`` has beside ``gone``, by the key of the row."""
    return rows.join(sized(stored(gone.select("row"), "gone")), "row", "left_anti").select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: ``und`` (null text, or no letter) goes, and so does what has no doc_id.

    Each row is decided by its own text. Without any labelled row to learn from, all texts with a letter stay.
    """
    model = train(docs.where(~held_out()))
    got = identified(docs.where("doc_id is not null").select(*COLUMNS), model)
    return got.where(F.col("lettered") & (F.lit(not model[0]) | (F.col("lang_pred") != "und"))).select(*COLUMNS)


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest doc_id, and of rows that share it the first by a hash of the text.

    Rows that share a doc_id are documents of their own, and stay if their texts are no near-duplicates.
    """
    rows = _keyed(docs)
    return _without(rows, jaccard_components(rows, key="row").where("row <> component_id"))


def contamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    rows = _keyed(docs)
    return _without(rows, contamination(rows, table(spark, sf_dir, "benchmark"), key="row").where("contaminated"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those of size 0 once."""
    rows = _keyed(docs)
    copies = mix(rows, key="row", by="doc_id").select("row", F.when(F.col("size") > 0, F.col("copies")).otherwise(1).cast("int").alias("copies"))
    wanted = sized(stored(copies.where("copies > 0"), "copies"))
    return rows.join(wanted, "row").select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select(*COLUMNS)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    return token_file_rows(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_stage),
    ("jaccard_join", duplicates_stage),
    ("decontamination", contamination_stage),
    ("mixing", mixing_stage),
    ("token_output", tokens_stage),
]

#: Classification, mixing and token encoding have no SQL form; the tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through all stages, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
