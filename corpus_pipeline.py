"""The corpus pipeline: quality, near duplicates, secrets, mixture, tokens.

Each stage works on all that the one before it kept, and is written before the next one reads it. All but the last
return the columns of documents; other columns, whatever their names, end at the first stage. Null, empty and very long
texts, repeated rows and empty tables have the results that the operators define:

1. quality: documents that the classifier scores below its threshold go; a null text is scored as an empty one.
2. near_duplicates: of documents linked by word shingles, that of smallest id stays, and of rows that are equal in id and text,
   one. Rows without an id stay.
3. secrets: each found secret becomes a mark; n_chars is that of the new text. No document goes.
4. mixture: each document as often as drawn for its source, in a shuffled order; so ids repeat, and some go.
5. tokens: a row per copy with its token ids.

SQL can express none of the stages but the mixture, so the pipeline is tested against a plain version of each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadgeo.llm import bpe, mixing, quality, secret_scan, shingle_join
from roadgeo.llm.common import staged, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Five words and a similarity of 0.8.
SHINGLE_WORDS, OF_UNION = 5, 80


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"), COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    linked = shingle_join.link(docs, SHINGLE_WORDS, OF_UNION)
    others = staged(linked.where("doc_id <> component_id").select("doc_id").distinct(), "near-copies")
    return docs.select(*COLUMNS).join(others, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"])


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs, COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, RANKS, public_tokenizers.PATTERN, keep_ids=True)


STAGES = [("quality", good), ("near_duplicates", distinct), ("secrets", without_secrets), ("mixture", mixed), ("tokens", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a directory."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
