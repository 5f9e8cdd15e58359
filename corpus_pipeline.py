"""Corpus pipeline: quality, near duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; its rows are written
and read again as the next one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, decontamination, quality, simhash
from gridloom.llm._common import staged, table
from gridloom.llm.queries import crc_is_two
from gridloom.sources import files

#: SQL can express neither the network nor the components; tests compare with brute force.
ORACLE_SQL = None
#: Bits by which fingerprints of near duplicates may differ at most, and the least similarity of near duplicates.
NEAR_BITS, NEAR_SIMILARITY = 13, 0.8


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from labelled rows as in its own query, and keeps all if there is nothing to learn from.

    A null text is scored as an empty one, whole texts at any length; each of repeated
    rows gets the same decision. All columns of docs come along, whatever their names. No
    documents give none.
    """
    net = quality.fit(docs.where(~F.coalesce(crc_is_two(4), F.lit(False))), table(spark, sf_dir, "labels"), "quality")
    return quality.accepted(docs, net) if isinstance(net, quality.ChunkNet) else docs


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: five-word shingles, similarity of 0.8 or more.

    The one of the smallest doc_id stays, of repeated ids one row; a null id comes last.
    Texts without words, null ones too, are near duplicates of each other. All columns come
    along. No documents give none.
    """
    return simhash.representatives(docs, radius=NEAR_BITS, similarity=NEAR_SIMILARITY)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Null texts have no words and stay; copies of one text stay or go together. All columns
    come along. With no items all documents stay.
    """
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded_sha256 of what the ids decode to.

    A null text has no ids and decodes to nothing. Each row has its own result, repeated
    ones too; other columns stay behind.
    """
    found = bpe.encode(docs, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN, decoded=True)
    return found.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_benchmark_copies),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder, each on all that the one before kept; empty tables and null texts as the stages have them.

    What a stage wrote on its way is deleted once its rows are written; these stay, for
    the last stage's result is read from them.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with files.scratch_scope(spark):
            kept = stage(spark, docs, sf_dir)
            with files.lasting():
                docs = staged(kept, f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
