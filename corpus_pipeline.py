"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
documents. All but the last return the columns of documents:

1. language: documents in which no language can be told go (no letters, or a score below 0.5);
2. exact: of documents with the same text the one with the largest doc_id stays;
3. near: of documents that links of similarity 0.75 join the one with the smallest doc_id stays;
4. mixed: documents in the order that training meets them, a row for each time the mix of sources takes one;
5. encoded: doc_id, n_tokens and the token ids of every row.

In every stage rows are judged one by one, repeated rows too, empty tables give empty ones, whole texts are read however long they are, and
columns of documents beyond those named come through unread.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm import bpe, exact_dedup, language_id, mixing, near_dedup
from triagelake.llm.common import materialise

#: Language ID, near-duplicate search and curriculum order have no SQL form.
ORACLE_SQL = None
#: The least score of a language that a document needs.
LEAST_SCORE = 0.5


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told. Null and empty texts and those without letters go; a null lang or id is no reason to go."""
    model = language_id.fit(docs.filter(~language_id.held_out(F.col("doc_id"))))
    found = language_id.annotate(docs, model)
    return found.filter((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, null counting as empty: the one with the largest doc_id, a null id only where all are; of repeated rows one."""
    marked = exact_dedup.one_of_repeats(exact_dedup.mark_duplicates(docs))
    return marked.filter("kept").select(*docs.columns)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: the one with the smallest doc_id. Null ids and texts without words stay."""
    found = near_dedup.near_duplicates(docs)
    gone = found.filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training order, a row for each time that the mix takes one. A null source is one of its own; texts without words
    have no size, and the mix takes them where their place in the queue comes up."""
    return mixing.training_order(docs, mixing.mix(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row; a null text has none."""
    import public_tokenizers as tokenizers

    found = bpe.encode_documents(docs, ranks_file=tokenizers.path("byte_bpe_50k.tiktoken"), pattern=tokenizers.PATTERN)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", keep_language),
    ("exact", keep_one_copy),
    ("near", keep_one_of_near),
    ("mixed", mix_sources),
    ("encoded", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table, each one's result written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
