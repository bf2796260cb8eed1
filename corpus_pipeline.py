"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera import scratch
from tessera.llm import decontaminate, langid, mixing, near_dedup, token_output
from tessera.llm.common import free_shuffles, read_table

#: Words whose ids a worker keeps while it writes tokens; the ids are the same whatever it is.
CACHED_WORDS = 120_000

#: SQL can't express the language model, the alignments or the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the language model rejects: texts that are null or without a letter (`und`), and those whose
    share of known words is below langid's MIN_KNOWN, such as texts in an unlearned script.

    The model is fitted on the labelled rows of docs (a bounded sample); every row is predicted.
    """
    return langid.keep_languages(docs, langid.fit_language_model(docs), min_known=langid.MIN_KNOWN)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: the one with the smallest id.

    Null texts, texts without words and rows without an id stay; rows that repeat an id go or stay by their own texts.
    """
    return near_dedup.drop_near_duplicates(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a passage that copies a test item; null and empty texts stay, repeated rows are judged each."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its Poisson draw for its source's target rate, in global random order.

    A null source is a source like any other; rows that repeat an id share a draw.
    """
    columns = docs.columns
    return mixing.mix_sources(docs).select(*columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token ids as DAC shards and reads them back: doc_id, start, n_tokens, ids_crc32.

    Documents keep the order in which docs is stored, which is that of mixing. A null text is the end id alone.
    Workers keep the ids of fewer words than alone: the stages before this one have grown the executors' memory already.
    """
    manifest, folder = token_output.write_tokens(docs, token_output.tokenizer_file(), by_id=False, cached_words=CACHED_WORDS)
    return token_output.read_tokens(manifest, folder)


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mix_sources", mixing_stage),
    ("token_output", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again, and its input dropped then; empty tables give an empty result."""
    docs, before = read_table(spark, sf_dir, "documents"), scratch.mark()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            free_shuffles(spark)
            path = scratch.scratch_path(spark, f"stage-{k}-{name}")
            docs.write.option("compression", "zstd").parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
            scratch.release(before, keep=path)  # this stage's input and what it wrote on its way
    return docs
