"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; what it returns is
written as Parquet to the shared folder and read again as the next stage's documents. A stage's input is
removed once its output is written.

All stages take null and repeated ids, null, empty and very long texts, repeated rows, an empty table and
further columns of any name; what each does with them stands in its docstring.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm import decontaminate, langid, packing, secrets, simhash, tokens
from newsloom.llm.common import held_out, remove, shared_dir, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents written in a language that the labelled ones teach, by cosine with its profile.

    Null texts, texts without a letter and texts that are like no learnt language by more than chance go; where no
    language can be learnt, texts with a letter stay. Ids don't matter; repeated rows share their fate.
    """
    profiles = langid.fit(docs.where(~held_out()).select("text", "lang"))
    return langid.admit(docs, profiles)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked SimHash fingerprints: the one with the least id.

    A document without an id stays only where its group has no other; null and empty texts are one group;
    of repeated rows one stays; two texts under one id are judged apart.
    """
    return simhash.representatives(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Rows are judged by their own text, with or without an id; null and empty texts stay; an empty benchmark keeps all.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced and n_chars renewed.

    Null texts stay null with their n_chars; which random runs are secrets is decided over all texts together.
    """
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes, in tokens: bin, offset, capacity.

    Null and empty texts are pieces of length 0; rows without an id and repeated rows are packed each time they occur.
    """
    return packing.pack(tokens.lengths(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language id", language),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("secret scans", secret_spans),
    ("best-fit packing", packed),
]

#: No SQL states hyperdimensional profiles or latent retrieval; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        if i:
            remove(spark, f"{folder}/{i - 1}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
