"""A cleaning pipeline over ``documents``: each stage is written as Parquet in the shared folder and read again by the next.

1. toxicity: documents that score 0.7 or more go.
2. near duplicates: one document of each group stays.
3. decontamination: documents in which a benchmark window occurs go.
4. secrets: secrets are masked in the texts, and n_chars follows; every document stays.
5. tokens: texts are encoded, decoded again, and the ids are added.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import bpe, decontaminate, neardup, secrets, toxicity
from trackloom.llm.queries import VOCABULARY
from trackloom.llm.shared import bound_batches, read, stow


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go.

    Null, empty and wordless texts score as texts without a match and stay; repeated rows are judged each; without usable labels nothing is rejected but for what the
    seeds mark; an empty table stays empty; all columns stay, whatever their names.
    """
    return toxicity.clean(docs, read(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest doc_id.

    Null, empty and wordless texts are no duplicates and stay; of a repeated row one stays; a row without a doc_id stays if no row with one is in its
    group; an empty table stays empty; all columns stay, whatever their names.
    """
    bound_batches(spark)
    return neardup.deduplicate(docs)


def not_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go.

    Null and empty texts have no words and stay; null and empty items have no windows; repeated rows are judged each; an empty table stays empty, and an empty
    benchmark rejects nothing; all columns stay, whatever their names.
    """
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each run of overlapping secrets becomes "[secret]", and n_chars, if there is such a column, follows the text. Every document stays.

    Null texts stay null, with n_chars null; texts without secrets stay as they are; an empty table stays empty; all columns stay but for names that begin with two underscores.
    """
    bound_batches(spark)
    masked = secrets.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents, and the digest of the ids and of what they decode to (the same bytes as the text).

    Null texts count as empty: no ids, and the digest of no bytes; repeated rows are encoded each; an empty table stays empty. An input column named like one of the
    three new ones is replaced.
    """
    bound_batches(spark)
    ids, decoded = (next(n for k in range(len(docs.columns) + 1) if (n := f"_{name}{k}") not in docs.columns) for name in ("ids", "decoded"))
    coded = bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, into=ids, decoded=decoded)
    digests = bpe.digests(ids, decoded)
    return coded.select(*(c for c in docs.columns if c not in ("n_tokens", "ids_sha256", "decoded_sha256")), *digests)


STAGES = [("toxicity", not_toxic), ("near duplicates", one_of_each), ("decontamination", not_benchmark), ("secrets", no_secrets), ("tokens", tokens)]

#: SQL can express neither the scores nor the encoding; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stow(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
