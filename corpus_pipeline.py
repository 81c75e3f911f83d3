"""A corpus pipeline of five stages: quality, exact dedup, near dedup, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and is written as Parquet and
read again as the next one's input. All but the last return the columns of ``documents``. Cases that the
operators define (null and empty texts, repeated rows, empty tables) hold here as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vastgrain.llm import exact, neardup, packing, quality, secrets
from vastgrain.llm.common import ROW, free_name, keyed_table, materialize
from vastgrain.llm.queries import tokenizer_file

#: The least score of a document that stays.
KEEP_SCORE = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents the quality classifier doesn't reject; it learns from the table of labels.

    Null counts as empty; repeated rows are judged alike; without labels every score is 0.5, so all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = quality.train(docs, labels.filter(quality.fold(F.col("doc_id")) != 0))
    score = quality.score_column(weights)
    return docs.filter(score(F.coalesce("text", F.lit(""))) >= KEEP_SCORE)


def _kept_by(docs: DataFrame, decide) -> DataFrame:
    """The rows of ``docs`` that ``decide(table, row key)`` keeps; the key takes a name that no column has."""
    key = free_name(docs, ROW)
    table = keyed_table(docs, key=key)
    return table.join(decide(table, key).filter("kept").select(key), key, "left_semi").drop(key)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of equal texts: the longest, then the smallest doc_id, then the first row; null counts as empty."""
    return _kept_by(docs, lambda table, key: exact.exact_dedup(table, row_col=key))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near duplicates: the smallest doc_id, then the first row; texts without a word are one class."""
    return _kept_by(docs, lambda table, key: neardup.near_duplicates(table, row_col=key))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by the names of their kinds; every document stays, a null text as null."""
    clean = secrets.redactor()
    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all tokens into sequences; a row for each piece. Null counts as empty, repeated rows are packed each."""
    cut = packing.cut_documents(docs, tokenizer_file("byte_bpe_50k.json"))
    return packing.pack(cut.select("doc_id", "draw", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"))


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: The stages train, align and tokenise, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; stages before the last are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
