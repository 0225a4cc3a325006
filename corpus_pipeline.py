"""The corpus pipeline: documents in, tokenised training mix out.

Stages run in order; each one's result is written as Parquet and read back as the next one's
documents. All but the last keep the columns of ``documents``; ``n_chars`` follows the text.

Defined results: nulls in any column, empty tables and repeated rows pass every stage as the
operators define it; further columns of any name pass through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from simcat.llm import common, linededup, mixing, sentencepieces, simhash, toxicity
from simcat.llm.common import materialise, read_table


#: Columns that stages read or change.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Rows of an Arrow batch: workers of several stages stand beside each other in an executor.
BATCH_ROWS = 512


def configure(spark: SparkSession) -> None:
    """The operators' settings, with smaller batches."""
    common.configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def _apart(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Run a stage with all further columns under names that no operator uses."""

    @wraps(stage)
    def run_apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        configure(spark)
        aside = {c: f"_further_{i}" for i, c in enumerate(docs.columns) if c not in COLUMNS}
        out = stage(spark, docs.withColumnsRenamed(aside), sf_dir)
        return out.select(*[aside.get(c, c) for c in docs.columns]).withColumnsRenamed({v: k for k, v in aside.items()})

    return run_apart


@_apart
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects (score 0.5 or more) go."""
    return toxicity.fit_and_score(docs, read_table(spark, sf_dir, "labels")).filter("score < 0.5")


@_apart
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that 10 documents or more share go from all of them; no document goes."""
    kept = linededup.LineDedup(spark).insert(docs).apply(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("long"))


@_apart
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints within 3 bits (3-word shingles) stays."""
    return simhash.keep_one(docs)


@_apart
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of 80 % of the tokens that meets the raked source, language and topic shares; documents
    without a topic have no topic target."""
    topics = mixing.with_topic(docs, read_table(spark, sf_dir, "embeddings"))
    return mixing.mix_to_budget(topics, ["source", "lang", "topic"], unknown={"topic": "none"}).filter("sampled")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as SentencePiece ids: id, source, language, number of tokens, ids, the text they decode to."""
    configure(spark)
    coded = sentencepieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "source", "lang", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("simhash near-dedup", near_duplicates),
    ("mix sources", mix_sources),
    ("sentencepiece", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents below ``sf_dir``."""
    configure(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None
