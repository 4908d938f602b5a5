"""A training-corpus pipeline over the documents table, of operators in lanternrow.llm.

Each stage reads what the stage before it kept, decides over all of it, and returns the columns of
documents; the last returns each document's token ids as a digest. Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lanternrow.llm.tables import crc_mod, stored, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.7 or more go; the model learns from the labelled two thirds that aren't held out."""
    from lanternrow.llm.toxicity import drop_toxic

    return drop_toxic(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the row with the smallest doc_id stays."""
    from lanternrow.llm.exact import drop_copies

    return drop_copies(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a 5-word shingle Jaccard similarity of 0.8, the smallest doc_id stays."""
    from lanternrow.llm.jaccard import drop_linked

    return drop_linked(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, its numbers, names and units aside, go."""
    from lanternrow.llm.decontam import drop_contaminated

    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document that is left."""
    import public_tokenizers

    from lanternrow.llm.bpe import encode_column

    # stored, as its batches are bounded then; rows are digests
    return stored(encode_column(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN), "pipeline-tokens")


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("n-gram Jaccard join", ngram_jaccard), ("benchmark decontamination", decontaminate), ("byte-level BPE", byte_bpe)]

#: The stages' models and components can't be put as SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
