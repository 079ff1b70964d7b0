"""A training corpus from `documents`: language, near duplicates, benchmark passages, packing.

Every stage takes what the one before it kept; all but the last return the columns of `documents`.  An empty
table goes through every stage as an empty table, and a text of any length is read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import decontamination, language, near_duplicates, packing
from tickloom.llm.store import table, tables

#: A fitted dictionary, an LSH scan and a library tokenizer are not SQL; tests compare with brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; lang itself stays as it came.

    Null texts and texts without letters go.  Repeated rows are judged alike and stay each; null ids stay.
    """
    return language.keep_identified(docs, language.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, that with the smallest id; of repeated rows one.

    Two texts under one id are two documents.  Rows without an id belong to no class and all stay.
    """
    own = {c: f"__own_{k}" for k, c in enumerate(docs.columns)}
    kept = near_duplicates.representatives(docs).select(F.col("id").alias("__kept"), F.col("digest").alias("__kept_digest"))
    rows = docs.select(*[F.col(c).alias(n) for c, n in own.items()])
    number = F.col(own["doc_id"]).cast("long")
    rows = rows.withColumn("__digest", near_duplicates.text_digest(F.col(own["doc_id"]), F.col(own["text"]).cast("string")))
    chosen = rows.join(kept, (number == F.col("__kept")) & (F.col("__digest") == F.col("__kept_digest")), "left_semi")
    chosen = chosen.dropDuplicates([own["doc_id"], "__digest"])
    nameless = rows.filter(F.col(own["doc_id"]).isNull())
    return chosen.unionByName(nameless).select(*[F.col(n).alias(c) for c, n in own.items()])


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null and empty texts have none.  Repeated rows and null ids stay or go alike."""
    return decontamination.decontaminate(docs, tables(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, with their sequence and place.

    A null or empty text is one piece of one id, repeated rows are packed each, a null id stays null.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; each result is written to the shared folder and read again."""
    docs = tables(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
