"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), where ``docs`` is what the stage before it returned, written as Parquet and read again.
All stages but the last return the columns of ``docs``, whatever their names. An empty table gives an empty one in each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm import common, language, mixing, neardup, packing, secrets

NEEDED = ("doc_id", "text", "lang", "source")


def bundled(docs: DataFrame) -> DataFrame:
    """The columns that stages read, and all columns in ``__row``, so that no other column's name can clash."""
    return docs.select(*[c for c in NEEDED if c in docs.columns], F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null texts too) and those of which no language has half of the words.

    Repeated rows share their fate. If no row has a language to learn from, all documents go.
    """
    told = language.predict(bundled(docs), language.fit(docs))
    return told.filter((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= 0.5)).select("__row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of exact and near copies, that of the smallest doc_id.

    Null doc_ids come last, null texts are copies of each other, and repeated rows become one.
    """
    return neardup.deduplicated(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of each secret; ``n_chars``, if there, follows the text.

    All rows stay, repeated ones too; null texts stay null with their ``n_chars``.
    """
    clean = secrets.redact(docs)
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), length).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, in the order of training positions.

    A document is a unit here: the one that a source's target cuts is taken if half of its words or more are. Documents without
    words, null texts too, are not taken. A null source is one of its own. Repeated rows each count.
    """
    taken = mixing.takes(bundled(docs))
    times = F.when(F.col("size") > 0, F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size")))).otherwise(0).cast("int")
    each = taken.withColumn("__times", times).filter("__times > 0").select("__row", "doc_id", F.explode(F.slice("positions", F.lit(1), F.col("__times"))).alias("__position"))
    return each.repartitionByRange("__position", "doc_id").sortWithinPartitions("__position", "doc_id").select("__row.*")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences; a null text is one piece, the end id; repeated rows each give theirs."""
    return packing.packed(docs)


STAGES = [
    ("language", known_language),
    ("near duplicates", one_of_each_group),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("packing", sequences),
]

#: Mixture inference, hashing and tokenizers are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.written(docs, f"stage-{name.replace(' ', '-')}")
    return docs
