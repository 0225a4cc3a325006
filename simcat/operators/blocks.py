"""Exact top-k search with pruning: a catalog laid out in blocks around pivots (J-1).

``build_blocks`` writes the catalog once: every row goes to its nearest pivot (a bounded sample of the
catalog's own rows), rows are range-partitioned by (pivot, distance), which splits a pivot that draws a third of
them, and every ``block_rows`` neighbours become one row of the layout, with their centre, radius and largest norm.

``search_blocks`` scans that layout in place, some chunks of queries after others, as many as
``Params.broadcast_query_bytes`` allows in one scan, so a query set of any size never moves the catalog. For a query q and a block with
centre c, radius r and largest norm m no row scores above min(q.c + |q| r, |q| m) (Cauchy-Schwarz). A task
starts from the k-th best score among the pivots, which are rows themselves. The queries of a pivot meet the blocks
together: first those of the highest bounds, which raise the queries' k-th scores, then the others in runs of some
thousand rows, a run for those queries only whose bound for a block of it still reaches their k-th score, without the
blocks that none of them needs. What is skipped can't be among the k best, ties included, so the hits are
those of ``search``; the share of (query, row) pairs skipped comes with them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simcat import params as P
from simcat.operators.search import _FEW_QUERIES, _TILE_ELEMS, _TILE_ROWS, _TOL, _as_matrix, _Best, _few_equal, _lowest_kth, _query_arrays, _rank, _refuse_repeats, _thin, _Tile
from simcat.session import shared_dir

PIVOTS, BLOCK_ROWS = 256, 512
BLOCK_SCHEMA = "pivot int, ids array<long>, vectors binary, centre binary, radius double, norm double"
# A candidate of a task, or (without qid) its count of (query, row) pairs and of those scored.
_FOUND = "qid long, id long, score double, k int, pairs long, scored long"
# Vector components of the blocks that a task takes together.
_SLICE_COMPONENTS = 4 << 20
# Candidates that a task holds for the queries of one scan.
_HELD_CANDS = 4 << 20
# Scans at a time: the next one's tasks fill the cores that the last tasks of one leave.
_SCANS = 2


@dataclass
class BlockIndex:
    """A written layout: its folder, pivot vectors (rows of the catalog) and dimension."""

    path: str
    pivots: np.ndarray
    dim: int

    def blocks(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(BLOCK_SCHEMA).parquet(self.path)


def _packer(dim: int, block_rows: int):
    """Rows (pivot, id, vector) in order -> blocks of one pivot each."""

    def block(pivot: int, ids: np.ndarray, vectors: np.ndarray) -> dict:
        centre = vectors.mean(axis=0)
        return {"pivot": pivot, "ids": ids.tolist(), "vectors": vectors.astype("<f8").tobytes(), "centre": centre.astype("<f8").tobytes(),
                "radius": float(np.sqrt(((vectors - centre) ** 2).sum(axis=1)).max()), "norm": float(np.sqrt((vectors**2).sum(axis=1)).max())}

    schema = pa.schema([("pivot", pa.int32()), ("ids", pa.list_(pa.int64())), ("vectors", pa.binary()), ("centre", pa.binary()), ("radius", pa.float64()), ("norm", pa.float64())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # (pivot, ids, vectors) that don't fill a block yet
        for batch in batches:
            if not batch.num_rows:
                continue
            pivots, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            vectors, out = _as_matrix(batch.column(2), batch.num_rows, dim, batch.column(1)), []
            cuts = np.r_[0, np.flatnonzero(np.diff(pivots)) + 1, len(pivots)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                pivot, i, v = int(pivots[a]), ids[a:b], vectors[a:b]
                if held is not None and held[0] == pivot:
                    i, v = np.concatenate([held[1], i]), np.concatenate([held[2], v])
                elif held is not None:
                    out.append(block(*held))
                whole = len(i) // block_rows * block_rows
                out += [block(pivot, i[at : at + block_rows], v[at : at + block_rows]) for at in range(0, whole, block_rows)]
                held = (pivot, i[whole:], v[whole:]) if whole < len(i) else None
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if held is not None:
            yield pa.RecordBatch.from_pylist([block(*held)], schema=schema)

    return pack


def build_blocks(catalog: DataFrame, path: str | None = None, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS) -> BlockIndex:
    """Write the layout of a catalog (id, vector) of one dimension (V-9). ``pivots``: how many of its rows, those with the
    smallest hash of their id, the others are laid around; every row is laid out."""
    spark = catalog.sparkSession
    path = path or shared_dir(spark, "blocks")
    rows = catalog.select(F.col("id").cast("long").alias("id"), "vector")
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(pivots).toArrow()
    dim = len(drawn.column("vector")[0]) if drawn.num_rows and drawn.column("vector")[0].is_valid else 0
    centres = _as_matrix(drawn.column("vector"), drawn.num_rows, dim, drawn.column("id").combine_chunks()) if drawn.num_rows else np.zeros((0, 0))
    sent = spark.sparkContext.broadcast(centres)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        half = (own**2).sum(axis=1) / 2
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _as_matrix(batch.column(1), batch.num_rows, dim, batch.column(0))
            closeness = v @ own.T - half
            best = closeness.argmax(axis=1)
            gap = (v**2).sum(axis=1) - 2 * closeness[np.arange(len(best)), best]
            yield pa.RecordBatch.from_arrays([pa.array(best.astype(np.int32)), pa.array(gap), batch.column(0), batch.column(1)], names=["pivot", "gap", "id", "vector"])

    vector_type = rows.schema["vector"].dataType.simpleString()
    placed = rows.mapInArrow(near, f"pivot int, gap double, id long, vector {vector_type}")
    order = ["pivot", "gap", "id"]
    dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("pivot", "id", "vector")
    dealt.mapInArrow(_packer(dim, block_rows), BLOCK_SCHEMA).write.parquet(path)
    return BlockIndex(path, centres, dim)


def _slices(batch: pa.RecordBatch, dim: int) -> Iterator[tuple]:
    """(cuts, ids, vectors, centres, radius, norm) of some blocks after others; rows cuts[b] to cuts[b + 1] are block b's."""
    cuts = np.r_[0, np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + _SLICE_COMPONENTS // max(1, dim), "right")) - 1)
        part = batch.slice(at, to - at)
        vectors, centres = (np.frombuffer(b"".join(part.column(i).to_pylist()), "<f8").reshape(-1, dim) for i in (2, 3))
        radius, norm = (part.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
        yield cuts[at : to + 1] - cuts[at], part.column(1).flatten().to_numpy(zero_copy_only=False), vectors, centres, radius, norm
        at = to


def _runs(blocks: np.ndarray, sizes: np.ndarray, rows: int) -> list[np.ndarray]:
    """Blocks one after another, cut into runs of about ``rows`` rows."""
    return np.split(blocks, np.flatnonzero(np.diff((np.cumsum(sizes[blocks]) - 1) // rows)) + 1) if len(blocks) else []


def _meet(best: _Best, size: np.ndarray, cuts: np.ndarray, ids: np.ndarray, vectors: np.ndarray, thin: np.ndarray | None, centres: np.ndarray, radius: np.ndarray, norm: np.ndarray) -> int:
    """The queries of ``best``, of norms ``size``, meet some blocks; the (query, row) pairs scored."""
    # a little above, for the rounding of the sums
    bounds = np.minimum(best.Q @ centres.T + size[:, None] * radius, size[:, None] * norm) + 1e-9 * (1 + size[:, None] * norm)
    sizes, order = np.diff(cuts), np.argsort(-bounds.max(axis=0), kind="stable")
    # four times the rows in each of the first runs, so that few scores of a run reach the floors of the one before
    small = 4 * int(best.k.max()) * 4 ** np.arange(16)
    firsts = np.unique(1 + np.searchsorted(np.cumsum(sizes[order]), small[small < _TILE_ROWS]))
    *early, rest = np.split(order, firsts)
    scored = 0
    for i, run in enumerate([*early, *_runs(np.sort(rest), sizes, _TILE_ROWS)]):
        near = bounds[:, run] >= best.floor[:, None] - _TOL
        run, alive = run[near.any(axis=0) & (sizes[run] > 0)], np.flatnonzero(near.any(axis=1))
        if not len(run):
            continue
        if (np.diff(run) == 1).all():
            rows = slice(cuts[run[0]], cuts[run[-1] + 1])
        else:
            rows = np.concatenate([np.arange(cuts[b], cuts[b + 1]) for b in run.tolist()])
        best.meet(ids[rows], vectors[rows], None if thin is None else thin[rows], None if len(alive) == len(size) else alive)
        scored += len(alive) * int(sizes[run].sum())
        if i < len(early):
            best.reduce()
    return scored


def _scan(bq: np.ndarray, bk: np.ndarray, Q: np.ndarray, pivots: np.ndarray, dim: int):
    """The task of one chunk of queries over blocks."""

    def tiles() -> Iterator[tuple[np.ndarray, np.ndarray, _Best]]:
        """(positions, norms, candidates) of queries of one nearest pivot, their floors the k-th best scores among the pivots."""
        near, half, step = np.zeros(len(Q), np.int64), (pivots**2).sum(axis=1) / 2, _TILE_ELEMS // _TILE_ROWS
        floor, room = np.full(len(Q), -np.inf), _Tile()
        for at in range(0, len(Q) if len(pivots) else 0, max(1, _TILE_ELEMS // max(1, len(pivots)))):
            part = slice(at, at + max(1, _TILE_ELEMS // len(pivots)))
            near[part], floor[part] = (Q[part] @ pivots.T - half).argmax(axis=1), np.fmax(-np.inf, _lowest_kth(Q[part], pivots, bk[part]))
        order = np.argsort(near, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(near[order])) + 1):
            for at in range(0, len(own), step):
                i = own[at : at + step]
                yield i, np.sqrt((Q[i] ** 2).sum(axis=1)), _Best(Q[i], bk[i], floor[i], room)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pairs, scored = list(tiles()) if len(Q) else [], 0, 0
        for batch in batches:
            for cuts, ids, vectors, *bounds in _slices(batch, dim):
                pairs += len(Q) * len(ids)
                few = _few_equal(ids, vectors, int(bk.max())) if len(Q) >= _FEW_QUERIES else None
                if few is not None:
                    cuts, ids, vectors = np.searchsorted(few, cuts), ids[few], vectors[few]
                thin = _thin(vectors)
                for _, size, best in own:
                    scored += _meet(best, size, cuts, ids, vectors, thin, *bounds)
        for i, _, best in own:
            q, found, scores = best.result()
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(bq[i[q]], pa.int64()), pa.array(found, pa.int64()), pa.array(scores, pa.float64()), pa.array(bk[i[q]], pa.int32()),
                                                  *[pa.nulls(len(q), pa.int64())] * 2], names=["qid", "id", "score", "k", "pairs", "scored"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()), pa.nulls(1, pa.int32()), pa.array([pairs], pa.int64()), pa.array([scored], pa.int64())],
                                         names=["qid", "id", "score", "k", "pairs", "scored"])

    return run


def search_blocks(queries: DataFrame, index: BlockIndex, params: P.Params = P.DEFAULT, chunk_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, report): hits as ``search`` gives them for (qid, k, vector) queries; report: one row of pairs, scored and
    skipped_share over all tasks. ``chunk_rows``: queries of a chunk (default: by the byte budget); chunks that the
    byte budget allows together are broadcast and scanned for together."""
    spark = queries.sparkSession
    q = queries.select(F.col("qid").cast("long").alias("qid"), F.coalesce(F.col("k").cast("int"), F.lit(params.default_top_k)).alias("k"), "vector")
    held = shared_dir(spark, "block-queries")
    q.write.parquet(held)
    q = spark.read.schema(q.schema).parquet(held)
    _refuse_repeats([r[0] for r in q.groupBy("qid").count().filter("count > 1").limit(11).collect()])
    n, kmax = q.agg(F.count(F.lit(1)), F.coalesce(F.max("k"), F.lit(1))).first()
    # an empty catalog has no dimension: any queries will do
    dim = index.dim or (q.agg(F.max(F.size("vector"))).first()[0] or 0)
    most = max(1, min(params.broadcast_query_bytes // (8 * max(1, dim)), _HELD_CANDS // max(1, kmax)))
    chunk_rows = chunk_rows or most
    chunks, path = max(1, math.ceil(n / chunk_rows)), shared_dir(spark, "block-hits")
    # one scan answers as many chunks as the byte budget and the candidates that a task holds allow
    together = max(1, most // chunk_rows)

    def scan(c: int) -> str:
        table = q.filter(F.pmod(F.xxhash64("qid"), F.lit(chunks)).between(c, c + together - 1)).toArrow()
        arrays = _query_arrays(table, dim) if table.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, dim)))
        sent = spark.sparkContext.broadcast((*arrays, index.pivots))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _scan(*sent.value, dim)(batches)

        index.blocks(spark).mapInArrow(run, _FOUND).write.parquet(f"{path}/{c}")
        sent.unpersist()
        return f"{path}/{c}"

    with ThreadPoolExecutor(_SCANS) as some:
        paths = list(some.map(scan, range(0, chunks, together)))
    found = spark.read.schema(_FOUND).parquet(*paths)
    hits = _rank(found.filter("qid is not null").select("qid", "id", "score", "k"), kmax, params, n).drop("_raw_score")
    share = F.when(F.col("pairs") > 0, 1 - F.col("scored") / F.col("pairs")).otherwise(0.0)
    report = found.filter("qid is null").agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("scored"), F.lit(0)).alias("scored")).withColumn("skipped_share", share)
    return hits, report
