"""Exact top-k inner products from an impact-ordered, score-at-a-time index.

Vectors are integers after quantisation, so a posting segment is (dimension, impact): the
vectors of a block that hold just this value there. Segments of a block lie in descending
order of |impact|. For a tile of queries the accumulators take segment after segment; after
all segments down to impact m a vector's missing part is at most its residual norm over
the components below m times the query's norm (Cauchy-Schwarz). When the vectors whose
upper bound still reaches the k-th best lower bound (or a score found before) are fewer
work to score than the segments left, the scan stops: that is the proof that nothing else
can enter. Those possible members are then scored exactly, from the vectors themselves.

On Spark: rows with equal vectors are one entry of the index with their smallest k + 1 ids,
and equal query vectors are searched once, so a vector that a third of the rows hold costs
one row; both reductions happen before the shuffle. Index blocks are rows of a written
table and stay where they are; queries come in chunks of ``CHUNK`` distinct vectors, each
broadcast and run over all blocks, a job and an output file per chunk. Every task returns its best
rows per query, which are merged in two levels.

Defined results: vectors that are null or hold null or non-finite components, and rows with
null ids, take no part; rows with equal ids are rows of their own, as queries and as candidates; shorter
vectors are padded with zeros; equal scores go to the smaller id; a query never finds its own row;
fewer rows than k give them all; empty tables give empty tables. Scores are exact 64-bit integers; vectors
so large that a product could leave 64 bits raise an error that names them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shared_dir

#: Vectors of an index block, blocks' vectors of a task, queries of a chunk and of a tile.
BLOCK, PER_TASK, CHUNK, TILE = 2048, 8192, 4096, 256
#: Shares of a block's postings after which the proof is tried.
PROOF_AT = (0.5, 0.7, 0.85)
#: Quantised components are read up to this; beyond it no score fits 64 bits.
LIMIT = 1 << 62
_SALTS = 16
_PAIRS = 1 << 18


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, null if the vector can't take part."""
    value = F.transform(vector, lambda x: F.lit(float(scale)) * x.cast("double"))
    held = F.transform(value, lambda x: F.when(F.abs(x) < F.lit(float(LIMIT)), F.floor(x)).otherwise(F.lit(LIMIT)).cast("long"))
    sound = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.when(sound, held)


class Block:
    """A block of vectors with its posting segments in descending order of |impact|."""

    def __init__(self, vectors: np.ndarray):
        n, dims = vectors.shape
        self.vectors = vectors
        flat = vectors.ravel()
        at = np.flatnonzero(flat)
        impact, dim, member = flat[at], at % dims, at // dims
        order = np.lexsort((member, impact, dim, -np.abs(impact)))
        impact, dim, self.members = impact[order], dim[order], member[order]
        new = np.flatnonzero(np.r_[True, (impact[1:] != impact[:-1]) | (dim[1:] != dim[:-1])]) if len(at) else np.zeros(0, int)
        self.starts = np.r_[new, len(at)]
        self.impacts, self.dims = impact[new], dim[new]

    def residuals(self, below: int) -> np.ndarray:
        """Norms of the components whose |impact| is under ``below``, a little above."""
        rest = np.where(np.abs(self.vectors) < below, self.vectors, 0).astype(np.float64)
        return np.sqrt((rest * rest).sum(axis=1)) * (1 + 1e-9)

    def proof_points(self) -> dict[int, int]:
        """Segment -> |impact| under which nothing is accumulated yet, at the shares of PROOF_AT."""
        points, size = {}, np.abs(self.impacts)
        for share in PROOF_AT:
            s = int(np.searchsorted(self.starts, share * len(self.members)))
            while s < len(size) and s and size[s] == size[s - 1]:
                s += 1
            if 0 < s < len(size):
                points[s] = int(size[s - 1])
        return points


def possible_members(block: Block, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(vector, query) pairs that may be among the queries' best k; ``floor``: scores known to be reached k times."""
    n, dims = block.vectors.shape
    top = float(np.abs(block.vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * dims
    acc = np.zeros((n, len(queries)), np.int32 if top < 2**31 - 1 else np.int64)
    columns = np.ascontiguousarray(queries.T).astype(acc.dtype)
    norms = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
    points = block.proof_points()
    for s, (impact, dim) in enumerate(zip(block.impacts.tolist(), block.dims.tolist())):
        if s in points:
            bound = block.residuals(points[s])[:, None] * norms[None, :]
            low = floor
            if n >= k:
                low = np.maximum(floor, np.partition(acc - bound, n - k, axis=0)[n - k])
            # sums beyond 2^53 are rounded here: a little below is on the safe side
            may = acc + bound >= low - 1e-12 * np.abs(low, where=np.isfinite(low), out=np.zeros(len(low)))
            if np.count_nonzero(may) * dims <= (len(block.members) - block.starts[s]) * len(queries):
                return np.nonzero(may)
        acc[block.members[block.starts[s] : block.starts[s + 1]]] += columns[dim] * impact
    low = floor if n < k else np.maximum(floor, np.partition(acc, n - k, axis=0)[n - k])
    return np.nonzero(acc >= low)


class Best:
    """The best k rows of each query so far: score descending, id ascending."""

    def __init__(self, n: int, k: int):
        self.k, self.floor = k, np.full(n, -np.inf)
        self.query, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        q, s, i = np.r_[self.query, query], np.r_[self.score, score], np.r_[self.id, ids]
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        full, keep = place == self.k - 1, place < self.k
        self.floor[q[full]] = s[full]
        self.query, self.score, self.id = q[keep], s[keep], i[keep]


def search_block(block: Block, ids: list[np.ndarray], tile: np.ndarray, best: Best) -> None:
    """Add a block's rows to the ``best`` of a tile of queries; ids: of each vector, its rows' smallest."""
    counts, flat = np.array([len(x) for x in ids]), np.concatenate(ids)
    first = np.cumsum(counts) - counts
    vec, query = possible_members(block, tile, best.floor, best.k)
    for a in range(0, len(vec), _PAIRS):
        v, q = vec[a : a + _PAIRS], query[a : a + _PAIRS]
        score = np.einsum("ij,ij->i", block.vectors[v], tile[q])
        enters = score >= best.floor[q]
        v, q, score = v[enters], q[enters], score[enters]
        n = counts[v]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        best.add(np.repeat(q, n), np.repeat(score, n), flat[np.repeat(first[v], n) + inner])


def build_index(rows: DataFrame, k: int) -> DataFrame:
    """(rep, q, ids): distinct vectors, each under a number of its own, with their smallest k + 1 ids, dealt over tasks."""
    nth = F.row_number().over(Window.partitionBy("q").orderBy("id"))
    few = rows.withColumn("nth", nth).filter(F.col("nth") <= k + 1)
    classes = few.groupBy("q").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("rep"), "q", "ids"), "topk-classes")
    return materialise(classes.repartition(1 + classes.count() // PER_TASK, "rep"), "topk-index")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    lengths = column.value_lengths().to_numpy()
    out = np.zeros((len(lengths), dims), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    col = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, col] = column.flatten().to_numpy()
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k best other rows of every query row."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), quantised(F.col(vector), scale).alias("q"), is_query.alias("asks")).filter("id is not null and q is not null")
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "topk-rows")
    largest = F.array_max(F.transform("q", lambda x: F.abs(x)))
    dims, top = rows.agg(F.max(F.size("q")), F.max(largest)).first()
    dims, top = dims or 1, top or 0
    if dims * top * top >= 1 << 63:
        bad = [r[0] for r in rows.filter(largest > int(((1 << 63) // dims) ** 0.5) - 1).orderBy("id").select("id").limit(11).collect()]
        raise ValueError(f"scores may exceed 64 bits: ids {bad[:10]}{' ...' if len(bad) > 10 else ''}")
    index = build_index(rows.select("id", "q"), k)
    own = F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x * x)
    asked = materialise(rows.filter("asks").join(index.select("q", "rep"), "q").select("row", F.col("id").alias("query_id"), "rep", own.alias("own")), "topk-asked")
    reps = asked.select("rep").distinct()
    chunks = 1 + reps.count() // CHUNK
    chunk = F.pmod(F.xxhash64("rep"), F.lit(chunks))
    queries = materialise(index.join(reps, "rep", "left_semi").select("rep", "q", chunk.alias("chunk")), "topk-queries")
    path, schema = shared_dir(spark, "llm", "topk-found"), "rep long, id long, score long"
    for c in range(chunks):
        table = queries.filter(F.col("chunk") == c).select("rep", "q").orderBy("rep").toArrow()
        reps_c = table.column("rep").combine_chunks().to_numpy()
        sent = spark.sparkContext.broadcast((reps_c, _matrix(table.column("q").combine_chunks(), dims)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own, asked = sent.value
            tiles = [(at, asked[at : at + TILE], Best(len(asked[at : at + TILE]), k + 1)) for at in range(0, len(own), TILE)]
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(at, BLOCK)
                    block, ids = Block(_matrix(part.column(0), dims)), [np.array(x, np.int64) for x in part.column(1).to_pylist()]
                    for _, tile, best in tiles:
                        search_block(block, ids, tile, best)
            for at, _, best in tiles:
                yield pa.RecordBatch.from_arrays([pa.array(own[best.query + at], pa.int64()), pa.array(best.id, pa.int64()), pa.array(best.score, pa.int64())], names=["rep", "id", "score"])

        index.select("q", "ids").mapInArrow(run, schema).write.mode("append").parquet(path)
        sent.unpersist()
    found = spark.read.schema(schema).parquet(path)
    order = (F.col("score").desc(), F.col("id"))
    for by in (("rep", F.pmod(F.xxhash64("id"), F.lit(_SALTS))), ("rep",)):
        found = found.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("nth") <= k + 1).drop("nth")
    # a query's own row is one of those with its id and its vector's score with itself
    met = asked.join(found, "rep").withColumn("nth", F.row_number().over(Window.partitionBy("row", "id", "score").orderBy("id")))
    others = met.filter("not (query_id = id and score = own and nth = 1)")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(*order))
    return others.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "id", "score")
