"""The corpus pipeline: STAGES in order, each over all that its predecessor kept.

What holds for every stage: null texts are empty texts, null ids and repeated rows are allowed, columns of docs may have any
names (those beside doc_id, text and source are carried along), an empty table gives an empty one, a text of any length is
read whole. All stages but the last return the columns of docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import bpe, exact_dedup, mixing, queries, simhash, toxicity
from lorekeep.llm.common import stash, table, whole_text


#: Bytes of a batch that goes to a Python worker.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", f"{64 << 20}b", f"{4 << 20}b"


def small_batches(spark: SparkSession) -> None:
    """Have the pipeline's session hand Python 4 MB at a time where it was left at Spark's 64 MB.

    Two tasks of an executor hold several copies of a batch, in the heap, in Arrow and in the worker. The operators leave
    their session alone; that is the business of the application, which this is.
    """
    key, default, small = BATCH
    if spark.conf.get(key) == default:
        spark.conf.set(key, small)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; clean ones stay. Texts without words score the share of toxic labels.

    Equal texts score alike. Labels of no document teach nothing.
    """
    small_batches(spark)
    model = queries.toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model, queries.TOXIC)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, the one of smallest doc_id stays.

    A null id stays only in a group without any other; of rows that repeat the smallest id one stays.
    """
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that share 0.8 of their five-word shingles, the smallest doc_id stays.

    Texts without words are alike. Null and repeated ids are treated as among exact copies.
    """
    small_batches(spark)
    return simhash.drop_near_duplicates(docs, similarity=0.8, words=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; those of sources under their target weight occur again. A null source is one source.

    Sources whose documents have no words stay as they are. Equal rows go together.
    """
    return mixing.mix(docs).select(docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, token_ids, round_trip (whether the ids decode to the text), a row for each row of docs.

    Texts that are null or empty have no tokens; other columns are left out.
    """
    small_batches(spark)
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.round_trip(docs.select("doc_id", "source", "text"), path, pattern)
    return coded.select(
        "doc_id",
        "source",
        F.size("token_ids").cast("long").alias("n_tokens"),
        "token_ids",
        (F.col("decoded") == whole_text().cast("binary")).alias("round_trip"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", tokenise),
]

#: SQL can express neither the trained model nor the hash order of the mix; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is materialised before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stash(docs)
    return docs
