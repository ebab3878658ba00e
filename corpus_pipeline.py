"""The corpus pipeline: toxic documents go, copies and near copies go, sources are mixed, texts are encoded.

Each stage takes all that the one before kept, as Parquet, and but for the last returns rows with
the columns of documents.
"""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import byte_bpe, exact_dedup, mixing, simhash, toxicity
from millrace.llm.common import discard, materialise, table


#: Near copies have a similarity of five-word shingles of about 0.8 or more: of four fingerprints of 64 bits one differs
#: in at most 8 bits, and all together in at most 44. README has the shares that these bounds find and let in.
NEAR = {"radius": 8, "width": 5, "parts": 4, "within": 44}


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, scores below 0.3.

    Null texts count as empty, repeated rows are each judged, and an empty table stays empty. Without labels of both kinds
    all documents get one score, the share of toxic labels.
    """
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (white space aside) the one with the smallest doc_id.

    Null texts equal empty ones, a null doc_id counts as largest, of rows that repeat one stays.
    """
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by fingerprints as near as NEAR says the one with the smallest doc_id.

    Texts without words have one fingerprint and are linked. Rows without doc_id stay.
    """
    return simhash.keep_representatives(docs, **NEAR)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's budget takes it, in training order.

    Documents without words stay, once, at the end; null sources are one source; repeated rows are each planned.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's token ids, and digest of the text they decode to; null texts count as empty."""
    ranks = Path(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).read_bytes()
    return byte_bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)


STAGES = [("toxicity", toxic), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("byte-level BPE", encode)]
#: A classifier, hashes and a tokenizer can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if name != STAGES[0][0]:
            discard(before)  # the stage before wrote it, and nothing else reads it
    return docs
