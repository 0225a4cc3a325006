"""Catalog operators: keyed upsert (A-6, J-2, W-1, J-4), validation (V-4..V-9),
scans (S-2..S-5) and metrics (A-1).

Skew: any id may carry a third of a feed. Every per-id step here is either a
partial aggregate (count / min / max_by / min_by combine map-side before the
shuffle) or a join on a key that includes ``seq``, so a hot id is spread over
tasks and never collected whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simcat import params as P
from simcat.functions.text import ack_message, integral_id, is_blank, py_strip

CATALOG_COLUMNS = ["id", "text", "vector", "dim", "count", "created_at", "updated_at"]

# Reasons, in the order the service checks them.
REASON_ID = "ID must be positive"
REASON_LENGTH = f"text length must be within {P.MIN_TEXT_CHARS}..{P.MAX_TEXT_CHARS}"
REASON_BLANK = "Text cannot be empty"
REASON_VECTOR_EMPTY = "Vector cannot be empty"
REASON_DIM = "Vector dimension mismatch"


# ---------------------------------------------------------------- validation

def upsert_reason(id_col: Column, text_col: Column, vector_col: Column | None, dim: int | None) -> Column:
    """First failing rule of V-4, V-5, V-7, V-8, V-9 (null when the event is valid)."""
    rid = integral_id(id_col)
    length = F.char_length(text_col)
    rules = [
        (rid.isNull() | (rid <= 0), F.lit(REASON_ID)),
        (text_col.isNull() | (length < P.MIN_TEXT_CHARS) | (length > P.MAX_TEXT_CHARS), F.lit(REASON_LENGTH)),
        (is_blank(text_col), F.lit(REASON_BLANK)),
    ]
    if vector_col is not None:
        rules.append((vector_col.isNull() | (F.size(vector_col) == 0), F.lit(REASON_VECTOR_EMPTY)))
        if dim is not None:
            rules.append((F.size(vector_col) != dim,
                          F.format_string(f"{REASON_DIM}: expected {dim}, got %d", F.size(vector_col))))
    reason = F.lit(None).cast("string")
    for cond, msg in reversed(rules):
        reason = F.when(cond, msg).otherwise(reason)
    return reason


def vector_reason(vector_col: Column, dim: int | None) -> Column:
    """V-8, V-9 on embedded events: null when the vector is fit for the catalog."""
    reason = F.when(vector_col.isNull() | (F.size(vector_col) == 0), F.lit(REASON_VECTOR_EMPTY))
    if dim is not None:
        reason = reason.when(F.size(vector_col) != dim, F.format_string(f"{REASON_DIM}: expected {dim}, got %d", F.size(vector_col)))
    return reason


def validate_upserts(feed: DataFrame, dim: int | None = None, vector_col: str | None = "vector") -> tuple[DataFrame, DataFrame]:
    """Split a feed (seq, id, text[, vector], ts) into (valid, rejects).

    Valid rows have ``id`` as bigint and ``text`` stripped (the API strips)."""
    vec = F.col(vector_col) if vector_col else None
    return split_valid(feed.withColumn("reason", upsert_reason(F.col("id"), F.col("text"), vec, dim)))


def split_valid(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects) of a feed carrying its ``reason`` column (see ``upsert_reason``)."""
    valid = (tagged.filter(F.col("reason").isNull()).drop("reason")
             .withColumn("id", integral_id(F.col("id")))
             .withColumn("text", py_strip("text")))
    rejects = tagged.filter(F.col("reason").isNotNull())
    return valid, rejects


def check_dimension(catalog: DataFrame, dim: int) -> None:
    """V-9 over a whole table: raise with the offending ids (a missing vector has no dimension)."""
    bad = catalog.filter(~F.size("vector").eqNullSafe(F.lit(dim))).select("id").orderBy("id").limit(11).collect()
    if bad:
        ids = [r[0] for r in bad[:10]]
        raise ValueError(f"{REASON_DIM}: expected {dim}; ids {ids}{' ...' if len(bad) > 10 else ''}")


# ---------------------------------------------------------------- upsert

def fold_upserts(valid: DataFrame, embedder=None, dim: int | None = None) -> DataFrame:
    """A-6: one row per id -- n events, last text/vector by seq, first and last ts.

    Fixed-width values are folded first (a hash aggregate, combined map-side); the
    payload then is fetched for the winners only, by a join on (id, seq) that spreads a
    hot id. With an ``embedder`` the events carry no vectors and the winners' texts are
    embedded, one per id instead of one per event; where the embedder may fail a text, the winners
    must be events that it doesn't, and vectors unfit for ``dim`` are left out. An event delivered
    twice (equal id and seq) counts twice and its smaller text wins."""
    folded = valid.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(F.col("ts"), F.col("seq")).alias("t0"),
        F.max_by(F.col("ts"), F.col("seq")).alias("t1"),  # ts: epoch seconds (P-13)
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
    )
    payload = ["text"] + (["vector"] if "vector" in valid.columns else [])
    events = valid.select("id", F.col("seq").alias("last_seq"), *payload)
    won = events.join(folded, ["id", "last_seq"])
    if embedder is not None and not embedder.total:
        # before one row per id is taken: a key may have several vectors
        won = embedder.embed(won, "text", "vector").filter(vector_reason(F.col("vector"), dim).isNull())
        embedder, payload = None, ["text", "vector"]
    one = F.row_number().over(Window.partitionBy("id").orderBy("text"))
    won = won.withColumn("_nth", one).filter("_nth = 1").drop("_nth")
    if embedder is not None:
        won = embedder.embed(won, "text", "vector")
        payload = ["text", "vector"]
    return won.select("id", "n", *payload, "t0", "t1", "first_seq", "last_seq")


def empty_table(spark, ddl: str) -> DataFrame:
    """An empty DataFrame the optimizer knows is empty (``limit(0)`` becomes an empty
    local relation), so joins against it are removed at planning time."""
    fields = [f.strip().split(" ", 1) for f in ddl.split(",")]
    return spark.range(1).select(*[F.lit(None).cast(t).alias(n) for n, t in fields]).limit(0)


def empty_catalog(spark, vector_type: str = "array<float>") -> DataFrame:
    return empty_table(spark, f"id bigint, text string, vector {vector_type}, dim int, "
                              "count bigint, created_at bigint, updated_at bigint")


def merge_upserts(catalog: DataFrame, folded: DataFrame, how: str = "full_outer") -> DataFrame:
    """J-2: full outer join of the catalog with the folded feed (``left``: for a feed whose ids are all known).

    count' = coalesce(C.count, 0) + n; the feed's last text/vector and t1 win when
    its last seq is newer than the row's; created_at' = C.created_at unless the feed
    starts earlier (a late feed), else t0. With an in-order feed this is exactly
    the service's insert-or-update; out-of-order micro-batches converge to the same
    rows. Rows without seq bookkeeping count as older than any feed, and stay so:
    no feed, however early, sets their first seq or created_at. Ids absent
    from the feed keep their row. Both sides hold one row per id, so the join
    cannot skew. Output keeps ``first_seq`` / ``last_seq`` bookkeeping. When both sides
    carry a ``bucket`` (a function of the id) the join is on (bucket, id) and keeps it."""
    has_book = "last_seq" in catalog.columns
    bucket = ["bucket"] if "bucket" in catalog.columns and "bucket" in folded.columns else []
    c = catalog.select(*[F.col(x).alias(f"c_{x}") for x in CATALOG_COLUMNS + bucket],
                       *([F.col("first_seq").alias("c_first_seq"), F.col("last_seq").alias("c_last_seq")]
                         if has_book else [F.lit(None).cast("long").alias("c_first_seq"),
                                           F.lit(None).cast("long").alias("c_last_seq")]))
    f = folded.select(*[F.col(x).alias(f"f_{x}") for x in
                        ["id", "n", "text", "vector", "t0", "t1", "first_seq", "last_seq"] + bucket])
    on = [F.col(f"c_{x}") == F.col(f"f_{x}") for x in [*bucket, "id"]]
    j = c.join(f, on, how)
    col = F.col
    in_feed = col("f_id").isNotNull()
    in_cat = col("c_id").isNotNull()
    newer = in_feed & (col("c_last_seq").isNull() | (col("f_last_seq") > col("c_last_seq")))
    earlier = in_feed & in_cat & col("c_first_seq").isNotNull() & (col("f_first_seq") < col("c_first_seq"))
    vec = F.when(newer, col("f_vector")).otherwise(col("c_vector"))
    return j.select(
        F.coalesce(col("f_id"), col("c_id")).alias("id"),
        F.when(newer, col("f_text")).otherwise(col("c_text")).alias("text"),
        vec.alias("vector"),
        F.size(vec).cast("int").alias("dim"),
        (F.coalesce(col("c_count"), F.lit(0)) + F.coalesce(col("f_n"), F.lit(0))).cast("long").alias("count"),
        F.when(in_cat & ~earlier, col("c_created_at")).otherwise(col("f_t0")).cast("long").alias("created_at"),
        F.when(newer, col("f_t1")).otherwise(col("c_updated_at")).cast("long").alias("updated_at"),
        F.when(in_cat & col("c_first_seq").isNull(), F.lit(None))
        .otherwise(F.least(col("c_first_seq"), col("f_first_seq"))).cast("long").alias("first_seq"),
        F.greatest(col("c_last_seq"), col("f_last_seq")).cast("long").alias("last_seq"),
        *[F.coalesce(col("f_bucket"), col("c_bucket")).alias(b) for b in bucket],
    )


def upsert_actions(valid: DataFrame, catalog_ids: DataFrame) -> DataFrame:
    """W-1 + J-4 + P-14: one ack per event.

    The first event (lowest seq) of an id unknown to the catalog is ``inserted``,
    every other event ``updated``; of an event delivered several times (equal id and
    seq) one ack at most is ``inserted``. First events come from a partial aggregate and
    an anti join on the (unique) id; the flag returns through a join on (id, seq),
    whose hash spreads a hot id across tasks, and deliveries are counted per (id, seq)
    before it."""
    firsts = (valid.groupBy("id").agg(F.min("seq").alias("seq"))
              .join(catalog_ids.select("id"), "id", "left_anti")
              .withColumn("_ins", F.lit(True)))
    events = valid.groupBy("id", "seq").agg(F.count(F.lit(1)).alias("_times"))
    acts = (events.join(firsts, ["id", "seq"], "left")
            .select("id", "seq", "_ins", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))).alias("_time")))
    action = F.when(F.col("_ins") & (F.col("_time") == 1), F.lit("inserted")).otherwise(F.lit("updated"))
    return acts.select("seq", "id", action.alias("action"), F.lit("ok").alias("status"),
                       ack_message(F.col("id"), action).alias("message"))


def epoch_seconds(ts: Column) -> Column:
    """P-13: whole epoch seconds (truncated) of a timestamp; NTZ values are read as UTC
    (the session time zone is pinned to UTC)."""
    return F.unix_seconds(ts.cast("timestamp"))


def now_seconds() -> Column:
    """P-13 for live feeds without a ``ts`` column: ``int(time.time())``."""
    return F.unix_seconds(F.current_timestamp())


# ---------------------------------------------------------------- scans

def lookup(catalog: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """S-3: catalog rows whose id appears in ``ids`` (left semi join)."""
    return catalog.join(ids.select(F.col(id_col).alias("id")), "id", "left_semi")


def exists_flag(ids: DataFrame, catalog: DataFrame, id_col: str = "id") -> DataFrame:
    """S-3/J-4 as a flag column: every input id with ``exists`` true/false."""
    known = catalog.select(F.col("id").alias("_kid")).distinct()
    j = ids.join(known, ids[id_col] == known["_kid"], "left")
    return j.select(*ids.columns, F.col("_kid").isNotNull().alias("exists"))


def page(catalog: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """S-4 / T-5: ``ORDER BY id LIMIT n OFFSET m`` (TakeOrderedAndProject for shallow pages)."""
    return catalog.orderBy("id").offset(offset).limit(limit) if offset else catalog.orderBy("id").limit(limit)


def page_after(catalog: DataFrame, last_id: int | None, limit: int) -> DataFrame:
    """Keyset paging for deep pages: ``WHERE id > last ORDER BY id LIMIT n``. On a catalog whose ``id``
    is a stored column the filter is pushed to the scan; over a computed id it is not."""
    df = catalog if last_id is None else catalog.filter(F.col("id") > F.lit(last_id))
    return df.orderBy("id").limit(limit)


def sample_rows(catalog: DataFrame, n: int = 1, seed: int | None = None) -> DataFrame:
    """S-5: ``n`` random rows. With a seed the draw is deterministic and
    engine-independent: rows ordered by md5(seed || id), then id."""
    if seed is None:
        return catalog.orderBy(F.rand()).limit(n)
    key = F.md5(F.concat(F.lit(str(seed)), F.col("id").cast("string")))
    return catalog.orderBy(key, F.col("id")).limit(n)


def catalog_metrics(catalog: DataFrame, model_name: str) -> DataFrame:
    """A-1: status, message, model, vectors_count (0 is a valid answer)."""
    return catalog.agg(F.count(F.lit(1)).alias("vectors_count")).select(
        F.lit("ok").alias("status"), F.lit("Service is running").alias("message"),
        F.lit(model_name).alias("model"), F.col("vectors_count"))


def metrics_of_count(spark, vectors_count: int, model_name: str) -> DataFrame:
    """A-1 when the size is already known (e.g. a snapshot's commit record)."""
    return spark.range(1).select(
        F.lit("ok").alias("status"), F.lit("Service is running").alias("message"),
        F.lit(model_name).alias("model"), F.lit(int(vectors_count)).cast("long").alias("vectors_count"))
