"""The registered queries of this package: name -> (builder(spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import alignment, decontamination, divergence, linededup, mixing, oracles, outliers, records, sentencepieces, sharding, simhash, tokencount, topk, toxicity
from .common import configure, read_table

SHARDS = 24
TOKEN_LIMIT = 2048
END_ID = 2
#: The source whose documents are taken out again.
TAKEN_DOWN = "src0"


def op1_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharding: 24 equal shards by rendezvous hashing of doc_id, and what a 25th would take."""
    configure(spark)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharding.shard_records(docs, [1.0] * SHARDS, "doc_id")
    slotted = sharding.number_slots(placed, "shard", "doc_id")
    return sharding.shard_records(slotted, [1.0] * (SHARDS + 1), "doc_id", shard="grown_shard").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2_mix_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixing to 80 % of the tokens: raked source, language and, where known, topic weights, and the sample they draw."""
    configure(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    docs = mixing.with_topic(docs, read_table(spark, sf_dir, "embeddings"))
    return mixing.mix_to_budget(docs, ["source", "lang", "topic"], unknown={"topic": "none"}).select(
        "doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 3).alias("cell_tokens"), F.round("probability", 9).alias("probability"), "sampled")


def op3_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact top-k search: each 20th vector's 20 best others by integer inner product."""
    configure(spark)
    found = topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)
    return found.withColumnRenamed("id", "vec_id").select("query_id", "rank", "vec_id", "score")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup: all documents inserted, lines found in 10 of them or more dropped everywhere."""
    configure(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = linededup.LineDedup(spark).insert(docs).apply(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))


def op4_line_dedup_takedown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup after a takedown: all documents inserted, the state opened again, the documents of one source
    deleted, and the lines that 10 of the others still share dropped from these."""
    configure(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    path = linededup.LineDedup(spark).insert(docs).path
    gone, stays = docs.filter(F.col("source") == TAKEN_DOWN), docs.filter(F.coalesce(F.col("source") != TAKEN_DOWN, F.lit(True)))
    kept = linededup.LineDedup(spark, path=path).delete(gone).apply(stays)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))


def op5_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: fingerprint and component of every document."""
    configure(spark)
    groups = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op6_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity: every document scored by a model of the labelled rows that aren't held out."""
    configure(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.fit_and_score(docs, read_table(spark, sf_dir, "labels"))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-ID output: all documents' ids written as framed records and read back."""
    configure(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    path = records.write_records(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    index = records.with_start(records.write_index(spark, path))
    return index.select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece: ids of every text with begin and end, and the text they decode to."""
    configure(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentencepieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_mcd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules: base counts of every text, and the robust outlier verdict per language and source; rows of
    small groups are judged by their language's estimate, or that of all rows."""
    configure(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return outliers.judge(docs, pools=[["lang"], []]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance", 4).alias("distance"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts: bytes and tokens of every text, and whether it exceeds 2048 tokens."""
    configure(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokencount.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: hit words and items of every text, windows of 10 words."""
    configure(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_leaks(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", decontamination.hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def op12_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source divergence: each group's distance to its language's other sources, and its own terms."""
    configure(spark)
    return divergence.audit(divergence.count_terms(read_table(spark, sf_dir, "documents")))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-tokenizer alignment: groups and links of every text, weighed by the corpus's pair counts."""
    configure(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    aligned = alignment.align(docs, *paths)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    scored = alignment.score(aligned.select("doc_id", *alignment.COUNTS, *alignment.PACKED, digest), *paths)
    return scored.select("doc_id", *alignment.COUNTS, "n_best", "count_sum", "groups_sha256")


QUERIES: dict = {
    "op1_rendezvous_sharding": (op1_rendezvous_sharding, oracles.op1_sql(SHARDS)),
    "op2_mix_to_targets": (op2_mix_to_targets, oracles.op2_sql()),
    "op3_impact_topk": (op3_impact_topk, oracles.OP3_SQL),
    "op4_line_dedup": (op4_line_dedup, oracles.op4_sql(linededup.THRESHOLD)),
    "op4_line_dedup_takedown": (op4_line_dedup_takedown, oracles.op4_sql(linededup.THRESHOLD, f"source IS DISTINCT FROM '{TAKEN_DOWN}'")),
    "op5_simhash_neardup": (op5_simhash_neardup, None),
    "op6_toxicity_ftrl": (op6_toxicity_ftrl, None),
    "op7_token_records": (op7_token_records, None),
    "op8_sentencepiece": (op8_sentencepiece, None),
    "op9_mcd_quality": (op9_mcd_quality, oracles.op9_sql()),
    "op10_token_counts": (op10_token_counts, None),
    "op11_decontamination": (op11_decontamination, oracles.op11_sql(decontamination.WIDTH)),
    "op12_divergence_audit": (op12_divergence_audit, oracles.op12_sql(divergence.LEAST_DOCS, divergence.SMOOTH, divergence.BEST)),
    "op13_token_alignment": (op13_token_alignment, None),
}
