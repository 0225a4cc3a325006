"""Exact cosine top-k search: queries x catalog (J-1, J-3, T-1..T-4, P-10..P-12).

Scores are computed block-wise in numpy inside Arrow tasks and only local top-k
candidates ever leave a task, so no plan materialises query x catalog pairs.

* ``broadcast`` plan: the query matrix (size checked against
  ``Params.broadcast_query_bytes``) is shipped once to every executor and the
  catalog is scanned in place with ``mapInArrow``; the catalog is never shuffled.
* ``blocked`` plan: queries are hashed into ``Bq`` blocks and catalog rows into
  ``Bc`` blocks; each (qb, cb) cell is one ``cogroup.applyInArrow`` task. Shuffle
  volume is |Q|*Bc + N*Bq vectors; both block counts are sized so one cell has
  a bounded number of pairs and fits a Python worker. Counts given by the caller are
  multiplied until they do.

Both plans emit per-task candidates in the order of the final ranking, (score desc,
id asc) with scores compared at ``TIE_DECIMALS``: the best k of a task, plus at most
k for each neighbouring value a score within half a unit of rounding could fall on.
A catalog of equal vectors thus gives k candidates per query and task, not all of
them. Scores are screened in single precision, with the largest error it can have added, and
only those that reach a query's k-th best so far are computed in double precision.
Candidates of few queries are ranked in two levels, by (query, hash of id) and then by query,
so one query with many tasks behind it is not one task's work; thousands of queries are
ranked by query alone. Output scores are rounded half-even then clamped. k comes from the queries in either plan.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simcat import params as P
from simcat.functions.text import is_blank
from simcat.functions.vector import TIE_DECIMALS, round_score, tie_key

CAND_SCHEMA = "qid long, id long, score double, k int"
# Scores this close below the local k-th can round to the same value at TIE_DECIMALS.
_TOL = 2.0 * 10.0 ** -TIE_DECIMALS
# First-level groups of one query's candidates.
_RANK_GROUPS = 32
# Queries from which on their number alone spreads the ranking over tasks, and up to which repeats of rows aren't sought.
_MANY_QUERIES, _FEW_QUERIES = 1 << 12, 64
# Cap on one score tile (queries x catalog rows) held in memory by a task; catalog rows of a tile, and the first rows
# whose scores are sorted to give queries a first floor; hits scored anew in double precision at a time.
_TILE_ELEMS, _TILE_ROWS, _HEAD_ROWS, _RESCORED = 1 << 19, 1024, 512, 1 << 11
# Vector components of the catalog rows that a task of the broadcast plan gathers before it scores them; candidates that
# it holds for one part of the queries.
_HELD_COMPONENTS, _HELD_CANDS = 16 << 20, 1 << 20
# Most pairs scored by one cell of the blocked plan, and bytes of a side's vectors: they bound its work and memory.
_CELL_PAIRS, _CELL_BYTES = 1 << 31, 128 << 20


# ---------------------------------------------------------------- query validation

def prepare_queries(queries: DataFrame, params: P.Params = P.DEFAULT, text_col: str | None = "text",
                    k_col: str | None = "top_k") -> tuple[DataFrame, DataFrame]:
    """V-6, V-7, V-10, T-3 on a queries DataFrame.

    Returns ``(valid, rejects)``; ``valid`` gains ``k`` (null -> default), ``rejects``
    has ``reason``. First failing rule wins, in the service's order: length, blank,
    k range."""
    k_raw = F.col(k_col) if k_col else F.lit(None).cast("int")
    checks = []
    if text_col:
        length = F.char_length(F.col(text_col))
        checks.append((F.col(text_col).isNull() | (length < P.MIN_TEXT_CHARS) | (length > P.MAX_TEXT_CHARS),
                       f"text length must be within {P.MIN_TEXT_CHARS}..{P.MAX_TEXT_CHARS}"))
        checks.append((is_blank(F.col(text_col)), "Query text cannot be empty"))
    checks.append((k_raw.isNotNull() & (k_raw < 1), "top_k must be >= 1"))
    checks.append((k_raw.isNotNull() & (k_raw > params.max_top_k), f"top_k must be <= {params.max_top_k}"))
    reason = F.lit(None).cast("string")
    for cond, msg in reversed(checks):
        reason = F.when(cond, F.lit(msg)).otherwise(reason)
    tagged = queries.withColumn("reason", reason)
    valid = (tagged.filter(F.col("reason").isNull()).drop("reason")
             .withColumn("k", F.coalesce(k_raw.cast("int"), F.lit(params.default_top_k))))
    rejects = tagged.filter(F.col("reason").isNotNull())
    return valid, rejects


# ---------------------------------------------------------------- numpy kernels

def _as_matrix(arr, n: int, dim: int, ids, dtype=np.float64) -> np.ndarray:
    """An (n, dim) matrix, of the vectors' own type if ``dtype`` is None; raises with the ids of rows whose vector is
    null or has another length (V-9)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    wrong = pc.invert(pc.fill_null(pc.equal(pc.list_value_length(arr), dim), False))
    if pc.any(wrong).as_py():
        bad = pc.filter(ids, wrong).to_pylist()
        raise ValueError(f"vector dimension mismatch: expected {dim}; ids {bad[:10]}{' ...' if len(bad) > 10 else ''}")
    values = arr.flatten().to_numpy(zero_copy_only=False)
    return values.astype(dtype or values.dtype, copy=False).reshape(n, dim)


def _kth(S: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The k-th largest of each row; -inf where a row has fewer."""
    nq, nc = S.shape
    most = min(nc, int(k.max()))
    if not most:
        return np.full(nq, -np.inf)
    top = np.partition(S, nc - most, axis=1)[:, nc - most:]
    if (k == most).all():
        return top[:, 0]
    top = -np.sort(-top, axis=1)
    return np.where(k <= most, top[np.arange(nq), np.minimum(k, most) - 1], -np.inf)


def _lowest_kth(Q: np.ndarray, C: np.ndarray, k: np.ndarray) -> np.ndarray:
    """What each query's k-th best score among the rows is at least, however a product is summed."""
    noise = 2.0 ** -50 * (Q.shape[1] + 8) * np.sqrt((C ** 2).sum(axis=1).max(initial=0))
    return _kth(Q @ C.T, k) - noise * np.sqrt((Q ** 2).sum(axis=1))


def _tile_candidates(S: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, col) of every entry within _TOL of its row's k-th largest score."""
    if S.shape[1] <= int(k.max()):
        return np.nonzero(np.ones_like(S, dtype=bool))
    return np.nonzero(S >= (_kth(S, k) - _TOL)[:, None])


def _reduce_candidates(qidx: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: np.ndarray):
    """Keep, per query, what can be among its k best: scores within _TOL of the k-th, and of
    each value they round to the k smallest ids."""
    if qidx.size == 0:
        return qidx, ids, scores
    key = np.round(scores, TIE_DECIMALS)
    order = np.lexsort((ids, -key, qidx))
    qidx, ids, scores, key = qidx[order], ids[order], scores[order], key[order]
    first = np.r_[True, (np.diff(qidx) != 0) | (np.diff(key) != 0)]
    place = np.arange(qidx.size) - np.maximum.accumulate(np.where(first, np.arange(qidx.size), 0))
    few = place < k[qidx]
    qidx, ids, scores = qidx[few], ids[few], scores[few]
    order = np.lexsort((-scores, qidx))
    qidx, ids, scores = qidx[order], ids[order], scores[order]
    starts = np.r_[0, np.nonzero(np.diff(qidx))[0] + 1]
    sizes = np.diff(np.r_[starts, qidx.size])
    kth_pos = starts + np.minimum(k[qidx[starts]], sizes) - 1
    thr = np.repeat(scores[kth_pos], sizes)
    keep = scores >= thr - _TOL
    return qidx[keep], ids[keep], scores[keep]


def _slack(dim: int) -> float:
    """Twice the largest error of a dot product in single precision, as a share of the product of the norms."""
    return 2.0 ** -23 * (dim + 8)


def _thin(X: np.ndarray, scale: float = 1.0) -> np.ndarray | None:
    """The rows in single precision, their norm times ``scale`` as one more component: the product of a row of queries
    (scaled by ``_slack``) and a row of the catalog is no less than their exact score. None if a row doesn't fit."""
    norm = np.sqrt(np.einsum("ij,ij->i", X, X, dtype=np.float64))
    if not (norm < 1e15).all():
        return None
    out = np.empty((X.shape[0], X.shape[1] + 1), np.float32)
    out[:, :-1], out[:, -1] = X, norm * scale
    return out


def _few_equal(ids: np.ndarray, C: np.ndarray, k: int) -> np.ndarray | None:
    """Positions of the rows without those that k equal rows of no larger id stand before: they have the same scores and
    can't be among any query's k best. None if all rows stay."""
    C = np.ascontiguousarray(C)
    words, key = C.view(np.uint32).reshape(len(C), -1), np.empty(len(C), np.uint64)
    odd = np.random.default_rng(7).integers(0, 1 << 63, words.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for at in range(0, len(C), _RESCORED):
        key[at:at + _RESCORED] = (words[at:at + _RESCORED].astype(np.uint64) * odd).sum(axis=1, dtype=np.uint64)
    found = np.sort(key)
    if len(C) <= k or (found[k:] != found[:-k]).all():
        return None
    order = np.lexsort((ids, key))
    equal = np.r_[False, key[order[1:]] == key[order[:-1]]]
    at = np.flatnonzero(equal)
    for i in range(0, len(at), _RESCORED):
        some = at[i:i + _RESCORED]
        equal[some] = (C[order[some]] == C[order[some - 1]]).all(axis=1)
    place = np.arange(len(C)) - np.maximum.accumulate(np.where(equal, 0, np.arange(len(C))))
    return np.sort(order[place < k])


class _Tile:
    """Room for one tile of scores, taken once."""

    def __init__(self):
        self.scores, self.mask = np.empty(0, np.float32), np.empty(0, bool)

    def hits(self, Q: np.ndarray, C: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of the few products that reach the query's ``low``; eight at a time are looked at."""
        n = len(Q) * len(C)
        if n > len(self.scores):
            self.scores, self.mask = np.empty(n, np.float32), np.empty(n, bool)
        scores, mask = (x[:n].reshape(len(Q), len(C)) for x in (self.scores, self.mask))
        np.greater_equal(np.dot(Q, C.T, out=scores), low[:, None], out=mask)
        if n % 8:
            return np.nonzero(mask)
        flat = mask.reshape(-1)
        eight = np.flatnonzero(flat.view(np.uint64) != 0)
        at, bit = np.nonzero(flat.reshape(-1, 8)[eight])
        return np.divmod(eight[at] * 8 + bit, len(C))


class _Best:
    """The candidates of some queries that meet catalog rows part by part, and their k-th best scores so far (``floor``).

    Scores are screened in single precision against the floors, an upper bound each, so nothing near a floor is
    missed; the few that pass are computed in double precision."""

    def __init__(self, Q: np.ndarray, k: np.ndarray, floor: np.ndarray | None = None, tile: _Tile | None = None):
        self.Q, self.k, self.thin, self.tile = Q, k, _thin(Q, _slack(Q.shape[1])), tile or _Tile()
        self.floor = np.full(len(Q), -np.inf) if floor is None else floor
        self.kept, self.waiting, self.n = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), [], 0
        self.most = max(1 << 12, 2 * int(k.sum()))

    def meet(self, ids: np.ndarray, C: np.ndarray, thin: np.ndarray | None, of: np.ndarray | None = None) -> None:
        """Rows, ``thin`` as ``_thin`` gives it for them; ``of``: positions of the queries that meet them (all by default)."""
        every = np.arange(len(self.Q)) if of is None else of
        pick = slice(None) if of is None else of
        if self.thin is None or thin is None:
            r, c = _tile_candidates(self.Q[pick] @ C.astype(np.float64, copy=False).T, self.k[pick])
        else:
            if not (self.floor[pick] > -np.inf).all():
                head = C[:max(_HEAD_ROWS, 16 * int(self.k.max()))].astype(np.float64, copy=False)
                self.floor[pick] = np.fmax(self.floor[pick], _lowest_kth(self.Q[pick], head, self.k[pick]))
            low = np.nextafter((self.floor[pick] - _TOL).astype(np.float32), np.float32(-np.inf))
            r, c = self.tile.hits(self.thin[pick], thin, low)
        self._take(every[r], c, ids, C)
        if self.n > self.most:
            self.reduce()

    def _take(self, r: np.ndarray, c: np.ndarray, ids: np.ndarray, C: np.ndarray) -> None:
        """Equal rows get equal scores, wherever they are met: a product is summed by itself."""
        for at in range(0, len(r), _RESCORED):
            q, i = r[at:at + _RESCORED], c[at:at + _RESCORED]
            scores = np.einsum("ij,ij->i", self.Q[q], C[i].astype(np.float64, copy=False))
            reach = ~(scores < self.floor[q] - _TOL)
            self.waiting.append((q[reach], ids[i[reach]], scores[reach]))
            self.n += len(self.waiting[-1][0])

    def reduce(self) -> None:
        """Keep what can be among the k best, and raise the floors."""
        if not self.n:
            return
        q, ids, scores = (np.concatenate(x) for x in zip(self.kept, *self.waiting))
        self.waiting, self.n = [], 0
        if np.isnan(scores).any() or self._uneven(q):
            # many candidates of few queries, equal scores mostly
            q, ids, scores = _reduce_candidates(q, ids, scores, self.k)
        if len(q) and not self._uneven(q):
            order = np.argsort(q.astype(np.uint16) if len(self.k) <= 1 << 16 else q, kind="stable")
            q, ids, scores = q[order], ids[order], scores[order]
            count = np.bincount(q, minlength=len(self.k))
            S = np.full((len(self.k), count.max()), -np.inf)
            S[q, np.arange(len(q)) - (np.cumsum(count) - count)[q]] = scores
            kth = _kth(S, self.k)
            self.floor = np.fmax(self.floor, kth)
            keep = ~(scores < self.floor[q] - _TOL)
            q, ids, scores = q[keep], ids[keep], scores[keep]
        elif len(q):
            order = np.lexsort((-scores, q))
            q, ids, scores = q[order], ids[order], scores[order]
            last = np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, q) == self.k[q] - 1)
            self.floor[q[last]] = np.fmax(self.floor[q[last]], scores[last])
        if len(q) > 2 * self.most:
            q, ids, scores = _reduce_candidates(q, ids, scores, self.k)
        self.kept = q, ids, scores

    def _uneven(self, q: np.ndarray) -> bool:
        return len(self.k) * int(np.bincount(q).max(initial=0)) > 16 * len(q) + _TILE_ELEMS

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position of the query, id, score): the k best, and of equal scores at the end the k smallest ids."""
        self.reduce()
        q, ids, scores = self.kept
        more = (np.bincount(q, minlength=len(self.k)) > self.k)[q]
        if not more.any():
            return self.kept
        few = _reduce_candidates(q[more], ids[more], scores[more], self.k)
        return tuple(np.concatenate([x[~more], y]) for x, y in zip(self.kept, few))


def _score_block(Q: np.ndarray, k: np.ndarray, ids: np.ndarray, C: np.ndarray, thin: np.ndarray | None = None):
    """All candidates of one catalog block against all queries, tile by tile; what the tiles leave of some queries is
    reduced before others come, so equal scores, however many, are held for those only. ``thin``: of the block, if at hand."""
    thin = _thin(C) if thin is None else thin
    few = _few_equal(ids, C, int(k.max())) if len(Q) >= _FEW_QUERIES else None
    if few is not None:
        ids, C, thin = ids[few], C[few], None if thin is None else thin[few]
    nq, nc = len(Q), len(C)
    rows = max(1, nc if thin is None else min(nc, max(_TILE_ROWS, _TILE_ELEMS // max(1, nq))))
    step = max(1, _TILE_ELEMS // rows)
    out, tile = [], _Tile()
    for at in range(0, nq, step):
        best = _Best(Q[at:at + step], k[at:at + step], tile=tile)
        for r in range(0, nc, rows):
            best.meet(ids[r:r + rows], C[r:r + rows], None if thin is None else thin[r:r + rows])
        q, i, s = best.result()
        out.append((q + at, i, s))
    return tuple(np.concatenate(x) for x in zip(*out))


def _cand_batch(qids, ks, qidx, ids, scores) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(qids[qidx], pa.int64()), pa.array(ids, pa.int64()),
         pa.array(scores, pa.float64()), pa.array(ks[qidx], pa.int32())],
        names=["qid", "id", "score", "k"])


# ---------------------------------------------------------------- plans

_BROADCASTS: list = []


def release_broadcasts() -> None:
    """Drop the query matrices broadcast by earlier ``search`` calls whose results
    have been consumed (a long-running stream calls this after every batch)."""
    while _BROADCASTS:
        _BROADCASTS.pop().unpersist(blocking=False)


def _query_arrays(tbl: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(qids, ks, Q) from a fetched (qid, k, vector) Arrow table; every vector has ``dim``."""
    vec = tbl.column("vector").combine_chunks()
    return (tbl.column("qid").to_numpy().astype(np.int64),
            tbl.column("k").to_numpy().astype(np.int64),
            _as_matrix(vec, tbl.num_rows, dim, tbl.column("qid").combine_chunks()))


def _broadcast_candidates(spark: SparkSession, qids: np.ndarray, ks: np.ndarray, Q: np.ndarray,
                          catalog: DataFrame, dim: int) -> DataFrame:
    bc = spark.sparkContext.broadcast((qids, ks, Q))
    _BROADCASTS.append(bc)

    def local_topk(batches):
        bq, bk, bQ = bc.value
        if bq.size == 0:
            return
        ks = bk.astype(np.int32)
        part = max(1, _HELD_CANDS // int(bk.max()))
        rows = max(1, _HELD_COMPONENTS // dim)

        def found(ids, C):
            thin = _thin(C)
            # One part of the queries after another meets the gathered rows, so a task holds the candidates of a
            # part and not |Q| * k. A row dropped here is below the k-th best of a subset, hence below the final
            # k-th best too.
            for at in range(0, bq.size, part):
                Q, k = bQ[at:at + part], bk[at:at + part]
                yield _cand_batch(bq[at:at + part], ks[at:at + part], *_score_block(Q, k, ids, C, thin))

        held, n = [], 0
        for b in batches:
            if b.num_rows == 0:
                continue
            held.append((b.column(0).to_numpy(zero_copy_only=False), _as_matrix(b.column(1), b.num_rows, dim, b.column(0), None)))
            n += b.num_rows
            if n >= rows:
                yield from found(*(np.concatenate(x) for x in zip(*held)))
                held, n = [], 0
        if held:
            yield from found(*(np.concatenate(x) for x in zip(*held)))

    return catalog.select("id", "vector").mapInArrow(local_topk, CAND_SCHEMA)


def _cells(n_q: int, n_c: int, kmax: int, dim: int, least: tuple[int, int]) -> tuple[int, int]:
    """Blocks of queries and of catalog rows, multiples of ``least``, that keep a cell within its bounds. What a query
    sends to a catalog block and back (its vector, k candidates that are ranked) against what a row sends sets the
    blocks' shape."""
    most = max(1, _CELL_BYTES // (8 * max(1, dim)))
    c_rows = min(most, max(1, int(math.sqrt(_CELL_PAIRS * (1 + kmax / 2)))))
    q_rows = max(1, min(most, _CELL_PAIRS // c_rows, _HELD_CANDS // max(1, kmax)))
    return tuple(b * max(1, math.ceil(n / (b * rows))) for b, n, rows in zip(least, (n_q, n_c), (q_rows, c_rows)))


def _blocked_candidates(queries: DataFrame, catalog: DataFrame, dim: int, bq: int, bc: int) -> DataFrame:
    qb = F.pmod(F.xxhash64("qid"), F.lit(bq)).cast("int")
    cb = F.pmod(F.xxhash64("id"), F.lit(bc)).cast("int")
    q = (queries.select("qid", "k", F.col("vector").alias("qvec"), qb.alias("qb"))
         .withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(bc - 1)))).alias("q"))
    c = (catalog.select("id", F.col("vector").alias("cvec"), cb.alias("cb"))
         .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(bq - 1)))).alias("c"))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return pa.Table.from_batches([], schema=pa.schema(
                [("qid", pa.int64()), ("id", pa.int64()), ("score", pa.float64()), ("k", pa.int32())]))
        qids = left.column("qid").to_numpy()
        ks = left.column("k").to_numpy().astype(np.int64)
        Q = _as_matrix(left.column("qvec"), left.num_rows, dim, left.column("qid").combine_chunks())
        ids = right.column("id").to_numpy()
        C = _as_matrix(right.column("cvec"), right.num_rows, dim, right.column("id").combine_chunks(), None)
        qidx, cid, s = _score_block(Q, ks, ids, C)
        return pa.Table.from_batches([_cand_batch(qids, ks.astype(np.int32), qidx, cid, s)])

    return (q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb"))
            .applyInArrow(cell, CAND_SCHEMA))


def _rank(cands: DataFrame, kmax: int, params: P.Params, n_q: int) -> DataFrame:
    order = (tie_key(F.col("score")).desc(), F.col("id").asc())
    if n_q < _MANY_QUERIES:
        group = F.pmod(F.xxhash64("id"), F.lit(_RANK_GROUPS))
        first = cands.withColumn("rank", F.row_number().over(Window.partitionBy("qid", group).orderBy(*order)))
        cands = first.filter(F.col("rank") <= kmax).drop("rank")
    else:
        # tasks leave k candidates per query already: nothing is sorted before the exchange to drop more
        cands = cands.repartition("qid")
    ranked = cands.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
    ranked = ranked.filter((F.col("rank") <= kmax) & (F.col("rank") <= F.col("k")))
    return ranked.select("qid", "rank", "id",
                         round_score(F.col("score"), params.score_decimal_places).alias("score_rate"),
                         F.col("score").alias("_raw_score"))


def _refuse_repeats(qids: list) -> None:
    if qids:
        raise ValueError(f"repeated qid: {qids[:10]}{' ...' if len(qids) > 10 else ''}")


def search(queries: DataFrame, catalog: DataFrame, params: P.Params = P.DEFAULT, *,
           catalog_text: DataFrame | None = None, plan: str = "auto",
           blocks: tuple[int, int] | None = None, keep_raw: bool = False) -> DataFrame:
    """Top-k hits per query.

    ``queries``: (qid, k, vector) -- already validated (see ``prepare_queries``), one row
    per qid; a repeated qid raises, as its hits could not be told apart.
    ``catalog``: (id, vector) with one dimension throughout (V-9).
    ``catalog_text``: optional (id, text); when given, hits carry the text (J-3,
    late materialisation: text is fetched for the winners only).
    Returns (qid, rank, id, score_rate[, text])."""
    spark = catalog.sparkSession
    q = queries.select(F.col("qid").cast("long"),
                       F.coalesce(F.col("k").cast("int"), F.lit(params.default_top_k)).alias("k"),
                       F.col("vector"))

    fetched = None
    dim = None
    if plan in ("auto", "broadcast"):
        # Size check without an unbounded collect: the dimension comes from one row, then
        # one row more than the budget allows is fetched. Rows come back as Arrow
        # (columnar, straight into numpy), not as Python rows.
        first = q.select(F.size("vector").alias("d")).limit(1).collect()
        dim = first[0]["d"] if first and first[0]["d"] and first[0]["d"] > 0 else params.vector_dim
        max_rows = max(1, params.broadcast_query_bytes // (8 * dim))
        fetched = q.limit(max_rows + 1).toArrow()
        if fetched.num_rows > max_rows:
            if plan == "broadcast":
                raise ValueError(f"{fetched.num_rows}+ queries exceed the broadcast budget of {max_rows}")
            fetched = None
    if dim is None:
        probe = q.select(F.size("vector").alias("d")).limit(1).collect()
        dim = probe[0]["d"] if probe else params.vector_dim
    if fetched is not None:
        qids, ks, Q = _query_arrays(fetched, dim)
        _refuse_repeats([int(x) for x, n in zip(*np.unique(qids, return_counts=True)) if n > 1])
        n_q, kmax = len(qids), int(ks.max()) if ks.size else 1
        cands = _broadcast_candidates(spark, qids, ks, Q, catalog, dim)
    else:
        _refuse_repeats([r[0] for r in q.groupBy("qid").count().filter("count > 1").limit(11).collect()])
        n_q, kmax = q.agg(F.count(F.lit(1)), F.coalesce(F.max("k"), F.lit(1))).first()
        blocks = _cells(n_q, catalog.count(), kmax, dim, blocks or (1, 1))
        cands = _blocked_candidates(q, catalog.select("id", "vector"), dim, *blocks)
    # At most |Q| * k hit rows of ~32 bytes: broadcast them for the text fetch when
    # that fits the budget, so the catalog's text column is never shuffled.
    hits_bounded = n_q * kmax * 32 <= params.broadcast_query_bytes

    hits = _rank(cands, kmax, params, n_q)
    if not keep_raw:
        hits = hits.drop("_raw_score")
    if catalog_text is not None:
        texts = catalog_text.select("id", "text")
        hits = (F.broadcast(hits) if hits_bounded else hits).join(texts, "id", "inner")
        cols = ["qid", "rank", "id", "score_rate", "text"] + (["_raw_score"] if keep_raw else [])
        hits = hits.select(*cols)
    return hits
