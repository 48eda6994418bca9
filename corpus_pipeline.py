"""A training-data pipeline over ``documents``: each stage is written as Parquet and read again by the next.

Stages: documents scored as toxic go; of each group of near duplicates (five-word shingles, Jaccard 0.8 or more) the
one with the smallest doc_id stays; passages of 100 bytes or more that occur earlier are cut out; documents that leak
benchmark items go; what is left is encoded.

A document is a row: each is judged by its own text, whatever other rows have its doc_id. Defined results: null and
empty texts are no duplicates, lose nothing, leak nothing, and have the labelled share as their toxicity; rows without
a doc_id are treated like any other (among duplicates one with a doc_id stays before them); of rows that repeat a
doc_id and text one stays, if the text has words; ties of duplicates go by the text's hash. All stages but the last
return the columns of documents: other columns of the input, whatever their names, are left out, a missing lang,
source or n_chars is null. An empty table gives an empty result, and texts of any length run through whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import encode_table
from tessera.llm.decontamination import decontaminate
from tessera.llm.ngram_join import one_of_each
from tessera.llm.shared import cut, read, scratch_dir
from tessera.llm.substring_dedup import dedup
from tessera.llm.toxicity import toxicity

#: Documents with this score or more go: the operator's own threshold.
TOXIC = 0.3

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def documents(docs: DataFrame) -> DataFrame:
    return docs.select(*[(F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()])


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # a text's score is its own, so rows meet their scores by the text's hash
    docs = documents(docs).withColumn("key", F.coalesce(F.sha2("text", 256), F.lit("")))
    scores = toxicity(docs, read(spark, sf_dir, "labels"), F.lit(True), key="key")
    worst = scores.where(F.col("score") >= TOXIC).select("key").distinct()
    return docs.join(worst, "key", "left_anti").select(*COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(documents(docs), k=5, num=4, den=5)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = dedup(documents(docs), kept_text=True, carry=["lang", "source"])
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(documents(docs), read(spark, sf_dir, "benchmark"), "doc_id", "text").where("not leaked").select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_table(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"), ids=True)


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_join", without_near_duplicates),
    ("suffix_dedup", without_repeated_passages),
    ("decontamination", without_leaks),
    ("bpe", encoded),
]

#: SQL can't express the scores, the components and the token merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scratch_dir(spark)
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
