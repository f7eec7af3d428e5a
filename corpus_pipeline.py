"""Corpus pipeline: language ID, line dedup, n-gram Jaccard join, mixing of sources, packing.

Each stage takes (spark, docs, sf_dir) and returns the rows that the next one reads; all but the last return the columns
of `documents`. run() applies them in turn and writes each result to the checkpoint folder.

An empty table gives no rows in every stage. Rows with a null id, and different texts under one id, stay apart by their texts;
null and empty texts have no language, so the first stage rejects them.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm._arrow import cut
from trailmark.llm.langid import UNKNOWN, fit_language_id, with_language
from trailmark.llm.line_dedup import dedup_lines
from trailmark.llm.mixing import mix_sources
from trailmark.llm.ngram_join import similar_components
from trailmark.llm.packing import pack_documents

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document is rejected if no language has this share of its words.
LEAST_SCORE = 0.4
#: No source is repeated more often than this in the mix.
REPETITION_LIMIT = 1.5
TOKENIZER = "word_bpe_49k.json"


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and texts in which no language has LEAST_SCORE; fills in a missing lang."""
    told = with_language(docs, fit_language_id(docs))
    kept = told.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated three-line windows; a text that loses all its lines goes. n_chars follows the text."""
    kept = dedup_lines(docs, drop_emptied=True)
    return kept.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component: the one with the smallest id, a null one last, then with the smallest hash of
    its text. Documents are told apart by id and text, so different texts under one id, or without one, are different
    documents; rows equal in both are copies. Documents without words have no links; of those equal in id and text one stays.
    """
    # Parts that are never null, so that the join and the copies' removal share one shuffle of the texts.
    parts = {"k0": F.col("doc_id").isNull(), "k1": F.coalesce("doc_id", F.lit(0)), "k2": F.xxhash64("text")}
    keyed = docs.select(*[c.alias(k) for k, c in parts.items()], *COLUMNS)
    first = similar_components(keyed.select(F.struct(*parts).alias("key"), "text"), "key").where("component_id = key").select("key.*").distinct()
    return keyed.join(first, list(parts), "left_semi").dropDuplicates(list(parts)).select(*COLUMNS)


def mix_by_source(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Raises small sources by whole and part passes; every document is taken once at least. The rows lie in the order of
    the passes, their permuted blocks and the permuted rows of these, as packing takes them as they come."""
    mixed = mix_sources(docs, repetition_limit=REPETITION_LIMIT, cover=True)
    order = ["mix_pass", "mix_key", "mix_place"]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4,096 tokens, see pack_documents; the rows are packed in the order in
    which they come, partition by partition. A repeated row is packed as often as it comes."""
    return pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_languages),
    ("line_dedup", remove_repeated_lines),
    ("ngram_jaccard", keep_one_of_similar),
    ("mixing", mix_by_source),
    ("packing", pack_sequences),
]

#: SQL can't express the random field nor the tokenizer; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
