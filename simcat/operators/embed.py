"""Text -> vector operators (E-1..E-4) and the pluggable embedder interface (U-1).

All embedders are map-only: a document's vector depends on that row alone, so no
embedder shuffles. ``mean_pool`` is the separate aggregate form of E-2 for token
vector tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simcat import params as P
from simcat.functions.vector import L2_EPS
from simcat.operators.catalog import REASON_VECTOR_EMPTY, vector_reason

# Vector components that a task of ``mean_pool`` holds before it passes its sums on.
_HELD_COMPONENTS = 4 << 20
# Tokens that the hashing embedder takes from a batch at once (a longer document is taken whole).
_SLICE_TOKENS = 1 << 18

# ---------------------------------------------------------------- E-1 / E-2 / E-3

def truncate_tokens(tokens, max_len: int = P.MAX_TEXT_LENGTH) -> Column:
    """E-1: keep the first ``max_len`` tokens."""
    col = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.slice(col, 1, max_len)


def _pool_sums(batch: pa.RecordBatch, dim: int | None) -> tuple[pa.Array, np.ndarray, np.ndarray, int | None]:
    """(documents, sums, mask sums, dim) of a batch of (doc, mask, vec) rows; rows without a vector take no part.
    Raises when a vector has another length than ``dim``, or than the batch's first one."""
    batch = batch.filter(pc.is_valid(batch.column(2)))
    doc, mask, vec = batch.columns
    if not batch.num_rows:
        return doc, np.zeros((0, dim or 0)), np.zeros(0), dim
    lengths = pc.list_value_length(vec).to_numpy(zero_copy_only=False)
    dim = int(lengths[0]) if dim is None else dim
    if (lengths != dim).any():
        bad = doc.filter(pa.array(lengths != dim)).unique().to_pylist()
        raise ValueError(f"token vector dimension mismatch: expected {dim}; documents {bad[:10]}{' ...' if len(bad) > 10 else ''}")
    m = pc.fill_null(pc.cast(mask, pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    v = pc.fill_null(pc.cast(vec.flatten(), pa.float64()), 0.0).to_numpy(zero_copy_only=False).reshape(-1, dim)
    coded = pc.dictionary_encode(doc, null_encoding="encode")
    code = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    starts = np.r_[0, np.flatnonzero(np.diff(code[order])) + 1]
    return coded.dictionary, np.add.reduceat(v[order] * m[order, None], starts, axis=0), np.add.reduceat(m[order], starts), dim


def mean_pool(token_vectors: DataFrame, doc_col: str, pos_col: str, mask_col: str,
              vec_col: str, out_col: str = "vector", clamp: float = P.MIN_CLAMP_VALUE,
              dim: int | None = None) -> DataFrame:
    """E-2 as an aggregate: sum(vec_i * mask_i) / max(sum(mask_i), clamp) per document.

    Input is a long token table ``(doc, pos, mask, vec)``. A task sums the vectors of a batch as one matrix and
    holds one partial sum per document, so a document with a huge number of tokens is one row per task (more
    where a task meets more documents than it holds); behind the one shuffle partial rows of a document are summed
    as they stream by. Defined results: tokens without a vector take no part, null masks and components are 0,
    an all-masked document pools to zeros, a document without any vector has a null vector, and vectors
    of another length than ``dim`` (default: than the others) raise."""
    rows = token_vectors.select(F.col(doc_col).alias("doc"), F.col(mask_col).alias("mask"), F.col(vec_col).alias("vec"))
    kind = rows.schema["doc"].dataType.simpleString()
    partial = f"doc {kind}, total array<double>, n double"
    wanted = dim

    def batch_of(docs: list, sums: list, counts: list, arrow_type) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(docs, arrow_type), pa.array(sums, pa.list_(pa.float64())), pa.array(counts, pa.float64())], names=["doc", "total", "n"])

    def combine(batches):
        held, dim, arrow_type = {}, wanted, None

        def flush():
            for at in range(0, len(held), 1024):
                part = list(held.items())[at:at + 1024]
                yield batch_of([d for d, _ in part], [x[0] for _, x in part], [x[1] for _, x in part], arrow_type)
            held.clear()

        for batch in batches:
            arrow_type = batch.column(0).type
            # a document whose vectors are all missing still has a row
            for d in batch.filter(pc.is_null(batch.column(2))).column(0).unique().to_pylist():
                held.setdefault(d, [None, 0.0])
            docs, sums, counts, dim = _pool_sums(batch, dim)
            for d, s, n in zip(docs.to_pylist(), sums, counts.tolist()):
                mine = held.get(d)
                if mine is None or mine[0] is None:
                    held[d] = [s, n]
                else:
                    mine[0] += s
                    mine[1] += n
            if len(held) * (dim or 1) > _HELD_COMPONENTS:
                yield from flush()
        yield from flush()

    def finish(batches):
        last, total, n, arrow_type = None, None, 0.0, None

        def mean(total, n):
            return None if total is None else total / max(n, clamp)

        started = False
        for batch in batches:
            arrow_type, done = batch.column(0).type, []
            for d, s, m in zip(*(batch.column(i).to_pylist() for i in range(3))):
                s = None if s is None else np.array(s)
                if started and d == last:
                    if total is not None and s is not None and len(total) != len(s):
                        raise ValueError(f"token vector dimension mismatch: expected {len(total)}; documents {[d]}")
                    total, n = s if total is None else total if s is None else total + s, n + m
                    continue
                if started:
                    done.append((last, mean(total, n)))
                started, last, total, n = True, d, s, m
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in done], arrow_type), pa.array([v for _, v in done], pa.list_(pa.float64()))], names=["doc", "vector"])
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([last], arrow_type), pa.array([mean(total, n)], pa.list_(pa.float64()))], names=["doc", "vector"])

    sums = rows.mapInArrow(combine, partial).repartition("doc").sortWithinPartitions("doc")
    return sums.mapInArrow(finish, f"doc {kind}, vector array<double>").select(F.col("doc").alias(doc_col), F.col("vector").alias(out_col))


# ---------------------------------------------------------------- U-1 embedders

class Embedder:
    """``embed(df, text_col, out_col)`` adds an ``array<float>`` column."""

    name: str = "embedder"
    dim: int = 0
    # Every valid text gets a vector of ``dim``: a feed may be folded before it is embedded.
    total: bool = False
    # Vectors are looked up, not computed: cheaper to fetch again for a few rows than to keep for all.
    stored: bool = False

    def embed(self, df: DataFrame, text_col: str = "text", out_col: str = "vector") -> DataFrame:
        raise NotImplementedError

    def judge(self, df: DataFrame, text_col: str = "text", dim: int | None = None) -> DataFrame:
        """``df`` with a column ``reason``: why its vector is unfit (V-8, V-9), null where it is fit. The vectors aren't kept."""
        return self.embed(df, text_col, "_vector").withColumn("reason", vector_reason(F.col("_vector"), dim)).drop("_vector")


# Hash-and-count step of the hashing embedder: token lists -> dense signed counts.
# Tokens are dictionary-encoded per Arrow batch (C++), md5 runs once per distinct
# token, and one bincount over the flattened tokens builds every row: no per-row
# Python loop, and per-token Python work only for the vocabulary. A batch of long texts
# is taken in slices of bounded tokens, so its length isn't what a worker holds.
def _hash_count_udf(dim: int, eps: float = L2_EPS):
    most = _SLICE_TOKENS  # a closure value: travels with the function

    def dense(tokens: pa.Array) -> np.ndarray:
        import hashlib

        n = len(tokens)
        offsets = tokens.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        flat = tokens.values.slice(offsets[0], offsets[-1] - offsets[0])
        enc = pc.dictionary_encode(flat)
        vocab = enc.dictionary.to_pylist()
        digests = [hashlib.md5(t.encode("utf-8")).digest() for t in vocab]
        bucket = np.array([int.from_bytes(d[:4], "big") % dim for d in digests], dtype=np.int64)
        sign = np.array([1.0 if (d[4] >> 4) % 2 == 0 else -1.0 for d in digests], dtype=np.float64)
        idx = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        rows = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
        counts = np.bincount(rows * dim + bucket[idx], weights=sign[idx], minlength=n * dim).reshape(n, dim)
        # E-3 on exact integer counts: IEEE sqrt, divide and float32 rounding give the
        # same bits as the JVM expression ``l2_normalize`` and as DuckDB.
        norm = np.maximum(np.sqrt((counts * counts).sum(axis=1)), eps)
        return (counts / norm[:, None]).astype(np.float32)

    @F.arrow_udf(T.ArrayType(T.FloatType(), containsNull=False))
    def hashed_vectors(tokens: pa.Array) -> pa.Array:
        if isinstance(tokens, pa.ChunkedArray):
            tokens = tokens.combine_chunks()
        n = len(tokens)
        null = tokens.is_null()
        tokens = tokens.fill_null([]) if tokens.null_count else tokens
        ends = tokens.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        vec, at = np.empty((n, dim), np.float32), 0
        while at < n:
            upto = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
            vec[at:upto] = dense(tokens.slice(at, upto - at))
            at = upto
        out_offsets = pa.array(np.arange(n + 1, dtype=np.int32) * dim)
        return pa.ListArray.from_arrays(out_offsets, pa.array(vec.ravel(), type=pa.float32()), mask=null)

    return hashed_vectors


class HashingEmbedder(Embedder):
    """Deterministic, model-free embedder that DuckDB can reproduce.

    tokens  = non-empty pieces of ``split(lower(text), ' ')`` of the whole text (a hashing
              embedder has no context window; ``max_tokens`` applies E-1 when given)
    bucket  = int(md5(token)[0:8], 16) mod dim
    sign    = +1 when hex digit 9 of md5(token) is even, else -1
    vector  = L2-normalised signed bucket counts, float32 (E-3)

    Mean pooling (E-2) divides the count vector by the token count; that scale
    cancels in the L2 normalisation, so the counts are normalised directly. This
    keeps every step exact up to the final sqrt/divide, hence bit-identical across
    engines. Tokenising runs JVM-side; hashing, counting and normalising run in
    one Arrow UDF over whole batches. A null text has a null vector."""

    name = "hashing-md5"
    total = True

    def __init__(self, dim: int = 64, max_tokens: int | None = None):
        if not 1 <= dim <= 4096:
            raise ValueError("dim must be in 1..4096")
        self.dim = dim
        self.max_tokens = max_tokens
        self._count = _hash_count_udf(dim)

    def tokens(self, text: Column) -> Column:
        pieces = F.array_remove(F.split(F.lower(text), " "), "")
        return pieces if self.max_tokens is None else truncate_tokens(pieces, self.max_tokens)

    def vector_expr(self, text: Column) -> Column:
        return self._count(self.tokens(text))

    def embed(self, df: DataFrame, text_col: str = "text", out_col: str = "vector") -> DataFrame:
        return df.withColumn(out_col, self.vector_expr(F.col(text_col)))


class PrecomputedEmbedder(Embedder):
    """Vectors already exist in a table ``(key, vector)``: embedding is a join.

    The vector table is keyed and unique, so the join never multiplies rows; Spark
    picks broadcast or sort-merge from its size (AQE)."""

    name = "precomputed"
    stored = True

    def __init__(self, vectors: DataFrame, key_col: str, vector_col: str, dim: int, on: str = "id"):
        self.on = on
        self.vectors = vectors.select(F.col(key_col).alias("_vkey"), F.col(vector_col).alias("_vvec"))
        self.dim = dim

    def embed(self, df: DataFrame, text_col: str = "text", out_col: str = "vector") -> DataFrame:
        """The text is not read: the vector comes by the row's ``on`` column, null without one."""
        joined = df.join(self.vectors, df[self.on] == self.vectors["_vkey"], "left")
        return joined.drop("_vkey").withColumnRenamed("_vvec", out_col)

    def judge(self, df: DataFrame, text_col: str = "text", dim: int | None = None) -> DataFrame:
        """As for any embedder; the vectors are judged where they lie, and the rows meet the verdicts."""
        known = self.vectors.select("_vkey", vector_reason(F.col("_vvec"), dim).alias("_verdict"), F.lit(True).alias("_known"))
        joined = df.join(known, F.col(self.on) == F.col("_vkey"), "left")
        return joined.withColumn("reason", F.when(F.col("_known"), F.col("_verdict")).otherwise(F.lit(REASON_VECTOR_EMPTY))).drop("_vkey", "_verdict", "_known")


class ModelEmbedder(Embedder):
    """Wraps a user model as a batched Arrow UDF.

    ``make_model()`` runs once per Python worker and returns an ``encode`` function. Without a tokenizer it is
    ``encode(texts: np.ndarray[str]) -> (token_vectors[B, T, D], mask[B, T])``. With ``tokenize(text) -> ids`` it is
    ``encode(ids[B, T], mask[B, T]) -> token_vectors[B, T, D]``: ids are cut to ``max_text_length`` (E-1), the texts of an
    Arrow batch are sorted by their number of ids, and model batches take neighbours, so a batch is padded to
    lengths that hardly differ. Pooling (E-2) and normalisation (E-3) follow the service: masked mean with the
    clamp, then L2 with eps 1e-12 (not with ``normalize=False``), float32 out. A null text has a null vector."""

    def __init__(self, make_model: Callable, dim: int, name: str = P.MODEL_NAME,
                 batch_size: int = P.EMBEDDING_BATCH_SIZE, clamp: float = P.MIN_CLAMP_VALUE, normalize: bool = True,
                 tokenize: Callable[[str], list[int]] | None = None, max_text_length: int = P.MAX_TEXT_LENGTH, pad_id: int = 0):
        self.name = name
        self.dim = dim

        def pooled(tok: np.ndarray, mask: np.ndarray) -> np.ndarray:
            m = np.asarray(mask, dtype=np.float32)[..., None]
            mean = (np.asarray(tok, dtype=np.float32) * m).sum(axis=1) / np.maximum(m.sum(axis=1), clamp)
            if normalize:
                mean = mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), L2_EPS)
            return mean.astype(np.float32)

        def vectors_of(encode: Callable, texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim), np.float32)
            if tokenize is None:
                for at in range(0, len(texts), batch_size):
                    out[at:at + batch_size] = pooled(*encode(np.array(texts[at:at + batch_size], dtype=object)))
                return out
            ids = [tokenize(t)[:max_text_length] for t in texts]
            for rows in length_batches([len(x) for x in ids], batch_size):
                wide = max(1, max(len(ids[i]) for i in rows))
                padded, mask = np.full((len(rows), wide), pad_id, np.int64), np.zeros((len(rows), wide), np.int64)
                for k, i in enumerate(rows):
                    padded[k, :len(ids[i])], mask[k, :len(ids[i])] = ids[i], 1
                out[rows] = pooled(encode(padded, mask), mask)
            return out

        @F.arrow_udf(T.ArrayType(T.FloatType()))
        def embedded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encode = make_model()
            for texts in batches:
                valid = pc.is_valid(texts).to_numpy(zero_copy_only=False)
                vectors = vectors_of(encode, texts.drop_null().to_pylist())
                ends = np.r_[0, np.cumsum(np.where(valid, dim, 0))].astype(np.int32)
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(vectors.ravel(), pa.float32()), mask=pa.array(~valid))

        self._udf = embedded

    def embed(self, df: DataFrame, text_col: str = "text", out_col: str = "vector") -> DataFrame:
        return df.withColumn(out_col, self._udf(F.col(text_col)))


def length_batches(lengths: list[int], batch_size: int) -> list[list[int]]:
    """Rows in batches of at most ``batch_size``, neighbours in length: the padding of a batch stays small."""
    order = sorted(range(len(lengths)), key=lengths.__getitem__)
    return [order[at:at + batch_size] for at in range(0, len(order), batch_size)]
