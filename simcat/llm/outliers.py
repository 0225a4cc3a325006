"""Quality rules by robust multivariate outliers: minimum covariance determinant (MCD).

Each text becomes a few counts, and these a vector of transformed statistics. Per group
(language and source) MCD finds the centre and scatter of the most concentrated ``SHARE`` of the
rows that pass the base rules: from two starts (medians with interquartile scales; mean
and covariance of all) concentration steps keep the rows with the smallest Mahalanobis
distances and estimate again; the start that ends with the smaller determinant wins. A row
is rejected when its squared distance exceeds ``CUTOFF``.

DataFrame expressions only: means and covariances are aggregates, a distance is a Cholesky
factor and a forward substitution written out as columns, and the quantile of the distances
is read from a histogram of their logarithms, so a group of any size is a few hundred bins
after the map-side aggregation. Counts are taken once and written; every estimate is a
written table of one row per group and start.

``FLOOR`` is the least standard deviation of a statistic: differences smaller than that are
never a reason, even where a group hardly varies.

Defined results: null and empty texts have no words and fail the base rules; null languages
and sources are groups of their own; groups with fewer than ``LEAST`` rows that pass the base
rules are judged by their pool's estimate if pools are given, and reject nothing more if no
pool has that many rows either; equal texts in a group get equal verdicts; an empty table stays
empty; columns other than the text pass through, but for those with a result's name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, materialise, without

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
SHARE, STEPS, LEAST = 0.75, 6, 50
#: Least standard deviation of each statistic.
FLOOR = 0.25
#: Chi-square quantile of 5 degrees of freedom at 1 - 1e-6.
CUTOFF = 35.89
#: For 5 dimensions and SHARE: a covariance of the core times this is that of all normal rows.
CONSISTENCY = 1.41
#: Histogram bins per unit of a statistic, and of a distance's logarithm.
BINS = 64
STATS = ("s1", "s2", "s3", "s4", "s5")
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept")


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    keep = [c for c in docs.columns if c != text]
    t = F.coalesce(F.col(text), F.lit(""))
    bare = F.btrim(t, F.lit(SPACES))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+", -1))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    base = docs.select(*keep, words.alias("_words"), lines.alias("_lines"), F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"))
    hashed = base.select(
        *keep, "n_symbols", F.size("_words").cast("long").alias("n_words"), F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"))
    spans = F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.col("n_words").cast("int") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_hashes", i, WINDOW))))
    spanned = hashed.select(*keep, "n_symbols", "n_words", "word_chars", "n_dup_lines", F.coalesce(spans, F.array().cast("array<long>")).alias("_spans"))
    order = F.when(F.size(F.array_distinct("_spans")) < F.size("_spans"), F.array_sort(F.transform("_spans", lambda h, i: F.struct(h.alias("h"), i.alias("p")))))
    sorted_ = spanned.select(*[c for c in spanned.columns if c != "_spans"], order.alias("_order"))
    at = F.transform("_order", lambda x, i: F.when(
        (F.get(F.col("_order"), i - 1)["h"] == x["h"]) | (F.get(F.col("_order"), i + 1)["h"] == x["h"]), x["p"]))
    placed = sorted_.withColumn("_at", F.array_sort(F.array_compact(at)))
    # each repeated window adds the words up to the next one's start, 8 at most
    reach = F.zip_with("_at", F.slice("_at", F.lit(2), F.greatest(F.size("_at"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.coalesce(F.aggregate(F.filter(reach, lambda x: x.isNotNull()), F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long")
    return placed.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def statistics() -> list[Column]:
    """The transformed statistics of a row with words."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [F.log(n), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), F.log1p(10 * F.col("n_symbols") / n), F.log1p(10 * F.col("n_dup_lines") / n), F.col("n_repeat_words") / n]


def distance(stats: Sequence[str]) -> Column:
    """Squared Mahalanobis distance from the columns m_i (centre) and l_ij (Cholesky factor)."""
    y: list[Column] = []
    for i, s in enumerate(stats):
        rest = F.col(s) - F.col(f"m_{i}")
        for j in range(i):
            rest = rest - F.col(f"l_{i}{j}") * y[j]
        y.append(rest / F.col(f"l_{i}{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _cholesky(scatter: DataFrame, p: int) -> DataFrame:
    """Columns l_ij of the factor of the covariances v_ij, column by column."""
    for j in range(p):
        left = F.col(f"v_{j}{j}")
        for k in range(j):
            left = left - F.col(f"l_{j}{k}") * F.col(f"l_{j}{k}")
        scatter = scatter.withColumn(f"l_{j}{j}", F.sqrt(F.greatest(left, F.lit(1e-12))))
        for i in range(j + 1, p):
            below = F.col(f"v_{i}{j}")
            for k in range(j):
                below = below - F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}")
            scatter = scatter.withColumn(f"l_{i}{j}", below / F.col(f"l_{j}{j}"))
    return scatter


def _estimate(rows: DataFrame, by: Sequence[str], scale: float = 1.0) -> DataFrame:
    """Centre and factor of the scatter of each group's rows."""
    p = range(len(STATS))
    sums = [F.avg(STATS[i]).alias(f"m_{i}") for i in p] + [(F.covar_pop(STATS[i], STATS[j]) * scale + (FLOOR * FLOOR if i == j else 0.0)).alias(f"v_{i}{j}") for i in p for j in range(i + 1)]
    return _finish(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums), by)


def _finish(scatter: DataFrame, by: Sequence[str]) -> DataFrame:
    p = range(len(STATS))
    made = _cholesky(scatter, len(STATS))
    det = sum((F.log(F.col(f"l_{i}{i}")) for i in p[1:]), F.log(F.col("l_00")))
    return made.select(*by, "n", det.alias("log_det"), *[f"m_{i}" for i in p], *[f"l_{i}{j}" for i in p for j in range(i + 1)])


def _by(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; the other column names must differ."""
    mine = {k: f"_{k}" for k in keys}
    on = [F.col(k).eqNullSafe(F.col(mine[k])) for k in keys]
    return left.join(right.withColumnsRenamed(mine), on, how).drop(*mine.values())


def _median_start(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Medians and interquartile scales, read from histograms of the statistics."""
    p = range(len(STATS))
    each = rows.select(*by, F.posexplode(F.array(*[F.floor(F.col(s) * BINS) for s in STATS])).alias("stat", "bin"))
    bins = each.groupBy(*by, "stat", "bin").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy(*by, "stat")
    placed = bins.withColumn("upto", F.sum("n").over(own.orderBy("bin"))).withColumn("all", F.sum("n").over(own))
    at = {q: F.min(F.when(F.col("upto") >= q * F.col("all"), (F.col("bin") + 0.5) / BINS)).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)}
    spread = placed.groupBy(*by, "stat").agg(F.max("all").alias("n"), *at.values())
    scale = (F.col("q75") - F.col("q25")) / 1.349
    wide = spread.groupBy(*by).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("stat") == i, F.col("q50"))).alias(f"m_{i}") for i in p], *[F.max(F.when(F.col("stat") == i, scale * scale + FLOOR * FLOOR)).alias(f"v_{i}{i}") for i in p])
    return _finish(wide.withColumns({f"v_{i}{j}": F.lit(0.0) for i in p for j in range(i)}), by)


def _core(rows: DataFrame, fit: DataFrame, by: Sequence[str], share: float) -> DataFrame:
    """The rows nearest to the estimates: ``share`` of each group, rounded up to a histogram bin."""
    near = _by(rows, fit, by).withColumn("bin", F.floor(F.log(distance(STATS) + 1e-9) * BINS)).select(*rows.columns, "bin")
    bins = near.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy(*by)
    upto = bins.withColumn("upto", F.sum("n").over(own.orderBy("bin"))).withColumn("all", F.sum("n").over(own))
    edge = upto.groupBy(*by).agg(F.min(F.when(F.col("upto") >= share * F.col("all"), F.col("bin"))).alias("edge"))
    return _by(near, edge, by).filter("bin <= edge")


def mcd(rows: DataFrame, by: Sequence[str], share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """Centre and scatter factor of each group, the scatter scaled to that of all normal rows."""
    both = rows.select(*by, *STATS).withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    keys = [*by, "start"]
    fit = _median_start(rows, by).withColumn("start", F.lit(0)).unionByName(_estimate(rows, by).withColumn("start", F.lit(1)))
    fit = materialise(fit, "mcd-start")
    for step in range(steps):
        scale = CONSISTENCY if step == steps - 1 else 1.0
        fit = materialise(_estimate(_core(both, fit, keys, share), keys, scale), "mcd-step")
    best = F.row_number().over(Window.partitionBy(*by).orderBy("log_det", "start"))
    return fit.withColumn("best", best).filter("best = 1").drop("best", "start", "log_det")


def judge(docs: DataFrame, by: Sequence[str] = ("lang", "source"), text: str = "text", pools: Sequence[Sequence[str]] = ()) -> DataFrame:
    """``docs`` without the text, with the counts, base_failed, distance (null where there's no estimate, or the base rules fail) and kept.

    ``pools`` are coarser groups, () for all rows: a row whose group is too small for an estimate is
    judged by that of the first pool that isn't, made from all sound rows of the pool."""
    docs = without(docs, *RESULTS)
    aside = {c: f"own_{i}" for i, c in enumerate(docs.columns)}
    back, by, text = {v: k for k, v in aside.items()}, [aside[c] for c in by], aside[text]
    counted = counts(docs.withColumnsRenamed(aside), text)
    rows = materialise(counted.withColumn("base_failed", base_failed()).withColumns(dict(zip(STATS, statistics()))), "quality-counts")
    sound = rows.filter(~F.col("base_failed"))
    fit = mcd(sound, by).filter(F.col("n") >= F.lit(SHARE * LEAST)).drop("n")
    measured = _by(rows, fit, by, "left").select(*rows.columns, F.when(~F.col("base_failed"), distance(STATS)).alias("distance"))
    for pool in pools:
        own = [*[aside[c] for c in pool], "pool"]
        measured = materialise(measured.withColumn("pool", F.lit(0)), "quality-measured")
        # only pools that are asked for are estimated
        asked = materialise(measured.filter("distance is null and not base_failed").select(*own).distinct(), "quality-pools")
        fit = mcd(_by(measured.filter("not base_failed").select(*own, *STATS), asked, own), own).filter(F.col("n") >= F.lit(SHARE * LEAST)).drop("n")
        measured = _by(measured, fit, own, "left").select(*rows.columns, F.when(~F.col("base_failed"), F.coalesce(F.col("distance"), distance(STATS))).alias("distance"))
    verdict = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))
    return measured.withColumn("kept", verdict).drop(*STATS).withColumnsRenamed(back)
