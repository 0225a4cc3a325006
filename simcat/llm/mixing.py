"""Mixing sources to target weights by iterative proportional fitting (raking).

Documents are counted into cells (source x language x topic) by their tokens. The cell
weights are scaled, margin after margin, until the token shares of every source, every
language and every topic meet their targets. A document of a cell is then drawn with the
calibrated probability ``weight / tokens`` of its cell, scaled so that the largest is
``rate``; expected token shares of the sample are therefore the raked ones.

Everything is DataFrame expressions. The cell table doesn't grow with the documents, only
with the number of different margins; it is aggregated before any shuffle of its rows, so a
hot source is one row per task. It is written once, so every later read, and every repeated
task, sees the same probabilities to the last bit.

``mix`` scales to the largest probability, so its size follows from the rarest cell. ``mix_to_budget``
is given the size: expected tokens meet a budget, no probability exceeds ``rate``, and a target that
would need more than that is lowered to what its own documents hold; the others take up the rest.

Targets are tempered shares (share ** power, power 1 keeps the mix, 0 makes it even), or a
table per margin given by the caller.

Defined results: null margins are a value of their own; a document counts at least one
token, so empty texts take part; equal ids are drawn together, a row without an id is drawn
by its text; an empty table gives an empty sample; extra columns pass
through, but for those with a result's name.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, tmp_names, unit_hash, without

ROUNDS = 10
POWER = 0.85
RATE = 1.0
#: Share of all tokens that a mix to a budget has by default.
KEEP = 0.8
SEED = 7


def token_weight(text: Column) -> Column:
    """Words of a text, 1 at least."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)), F.lit(1)).cast("long")


def cell_counts(docs: DataFrame, margins: Sequence[str], tokens: str) -> DataFrame:
    return docs.groupBy(*margins).agg(F.sum(tokens).alias(tokens), F.count(F.lit(1)).alias("docs"))


def rake(cells: DataFrame, margins: Sequence[str], tokens: str, power: Mapping[str, float] | float = POWER, targets: Mapping[str, DataFrame] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """Add ``weight``: the raked share of each cell. ``targets[m]`` has columns (m, share); margins
    without one are tempered by ``power``. Values without a target keep their present share."""
    total = cells.agg(F.sum(tokens)).first()[0] or 1
    out = cells.withColumn("weight", F.col(tokens).cast("double"))
    goals = []
    for k, m in enumerate(margins):
        p = power[m] if isinstance(power, Mapping) else power
        per_value = cells.groupBy(F.col(m).alias("_value")).agg((F.sum(tokens) / F.lit(float(total))).alias("_had"))
        if targets and m in targets:
            given = targets[m].select(F.col(m).alias("_given"), F.col("share").cast("double").alias("_share"))
            per_value = per_value.join(given, F.col("_value").eqNullSafe(F.col("_given")), "left")
            goal = F.coalesce(F.col("_share"), F.col("_had"))
        else:
            goal = F.pow(F.col("_had"), F.lit(float(p)))
        goals.append((f"goal_{k}", Window.partitionBy(m)))
        out = out.join(per_value.select("_value", goal.alias(goals[-1][0])), F.col(m).eqNullSafe(F.col("_value"))).drop("_value")
    for _ in range(rounds):
        for goal, own in goals:
            out = out.withColumn("weight", F.col("weight") * F.col(goal) / F.sum("weight").over(own))
    return out.drop(*[g for g, _ in goals])


def sampling_rates(raked: DataFrame, tokens: str, rate: float = RATE) -> DataFrame:
    """Add ``probability``: weight per token of a cell, the largest scaled to ``rate``; weights are
    scaled to sum to 1. ``raked`` is read twice: pass a written table."""
    ratio = F.col("weight") / F.col(tokens)
    top, total = raked.agg(F.max(ratio), F.sum("weight")).first()
    return raked.withColumn("probability", ratio * F.lit(float(rate) / (top or 1.0))).withColumn("weight", F.col("weight") / F.lit(total or 1.0))


def mix(docs: DataFrame, margins: Sequence[str], text: str = "text", key: str = "doc_id", power: Mapping[str, float] | float = POWER, targets: Mapping[str, DataFrame] | None = None, rate: float = RATE, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """Every row of ``docs`` with n_tokens, weight (token share of its cell after raking),
    probability and sampled. Filter on ``sampled`` for the mix."""
    tokens = "n_tokens"
    docs = without(docs, tokens, "weight", "probability", "sampled")
    (cell,) = tmp_names(docs.columns, "cell")
    counted = docs.withColumn(tokens, token_weight(F.col(text)))
    cells = materialise(cell_counts(counted, margins, tokens), "mix-cells")
    raked = materialise(rake(cells, margins, tokens, power, targets, rounds), "mix-weights")
    rates = sampling_rates(raked, tokens, rate)
    rates = rates.select(F.struct(*margins).alias(cell), "weight", "probability")
    # the rates table's size is known from its files: Spark broadcasts it below its threshold
    joined = counted.join(rates, F.struct(*[counted[m] for m in margins]).eqNullSafe(rates[cell]), "left").drop(cell)
    draw = unit_hash(seed, F.col(key), F.when(F.col(key).isNull(), F.col(text)))
    return joined.withColumn("sampled", draw < F.col("probability"))


def fill(table: DataFrame, wanted: str, most: str, budget: float) -> float:
    """The factor c for which the sum of least(most, c * wanted) is ``budget``; infinite if all ``most``
    don't exceed it. ``table`` is read once a step, with more of its rows at their most in each."""
    c, full = 0.0, -1
    while True:
        at_most = F.col(wanted) * F.lit(c) >= F.col(most)
        n, held, open_ = table.agg(F.count_if(at_most), F.sum(F.when(at_most, F.col(most))), F.sum(F.when(~at_most, F.col(wanted)))).first()
        if n == full:
            return c
        if not open_ or (held or 0.0) >= budget:
            return float("inf")
        c, full = (budget - (held or 0.0)) / open_, n


def rake_to_budget(cells: DataFrame, margins: Sequence[str], tokens: str, budget: float, power: Mapping[str, float] | float = POWER, targets: Mapping[str, DataFrame] | None = None, rate: float = RATE, rounds: int = ROUNDS, unknown: Mapping[str, str] | None = None) -> DataFrame:
    """Add ``weight``, the expected tokens of each cell, and ``probability``: weights sum to ``budget``,
    and none exceeds ``rate`` times its cell's tokens. ``unknown[m]`` is a value of a margin that stands for
    not known: it has no target, and the known values' targets share their part of the budget.
    ``cells`` is read often: pass a written table."""
    most = F.lit(float(rate)) * F.col(tokens)
    total = cells.agg(F.sum(tokens)).first()[0] or 1
    out = cells.withColumn("_free", F.lit(budget / total) * F.col(tokens)).withColumn("_most", most)
    goals = []
    for k, m in enumerate(margins):
        p = power[m] if isinstance(power, Mapping) else power
        known = cells.filter(~F.col(m).eqNullSafe(F.lit(unknown[m]))) if unknown and m in unknown else cells
        part = budget * (known.agg(F.sum(tokens)).first()[0] or 0) / total
        values = known.groupBy(F.col(m).alias("_value")).agg((F.sum(tokens) / F.lit(float(total))).alias("_had"), F.sum(most).alias("_room"))
        goal = F.pow("_had", F.lit(float(p)))
        if targets and m in targets:
            given = targets[m].select(F.col(m).alias("_given"), F.col("share").cast("double").alias("_share"))
            values = values.join(given, F.col("_value").eqNullSafe(F.col("_given")), "left")
            goal = F.coalesce("_share", "_had")
        values = materialise(values.select("_value", "_room", goal.alias("_wanted")), "mix-goals")
        c = fill(values, "_wanted", "_room", part)
        goals.append((f"_goal_{k}", Window.partitionBy(m)))
        out = out.join(values.select("_value", F.least(F.col("_room"), F.col("_wanted") * F.lit(c)).alias(goals[-1][0])), F.col(m).eqNullSafe(F.col("_value")), "left").drop("_value")
    for _ in range(rounds):
        for goal, own in goals:
            # a value without a target has factor 1
            out = out.withColumn("_free", F.col("_free") * F.coalesce(F.col(goal) / F.sum(F.least("_free", "_most")).over(own), F.lit(1.0)))
    out = materialise(out.select(*cells.columns, "_free", "_most"), "mix-budget")
    c = fill(out, "_free", "_most", budget)
    out = out.withColumn("weight", F.least(F.col("_most"), F.col("_free") * F.lit(c)))
    return out.withColumn("probability", F.col("weight") / F.col(tokens)).drop("_free", "_most")


def mix_to_budget(docs: DataFrame, margins: Sequence[str], text: str = "text", key: str = "doc_id", budget: float | None = None, power: Mapping[str, float] | float = POWER, targets: Mapping[str, DataFrame] | None = None, rate: float = RATE, rounds: int = ROUNDS, seed: int = SEED, unknown: Mapping[str, str] | None = None) -> DataFrame:
    """As ``mix``, with ``budget`` expected tokens (``KEEP`` of all by default) and ``unknown`` values of
    margins left without a target; weight is the cell's expected tokens."""
    tokens = "n_tokens"
    docs = without(docs, tokens, "weight", "probability", "sampled")
    (cell,) = tmp_names(docs.columns, "cell")
    counted = docs.withColumn(tokens, token_weight(F.col(text)))
    cells = materialise(cell_counts(counted, margins, tokens), "mix-cells")
    if budget is None:
        budget = KEEP * (cells.agg(F.sum(tokens)).first()[0] or 0)
    rates = materialise(rake_to_budget(cells, margins, tokens, budget, power, targets, rate, rounds, unknown), "mix-rates")
    rates = rates.select(F.struct(*margins).alias(cell), "weight", "probability")
    joined = counted.join(rates, F.struct(*[counted[m] for m in margins]).eqNullSafe(rates[cell]), "left").drop(cell)
    draw = unit_hash(seed, F.col(key), F.when(F.col(key).isNull(), F.col(text)))
    return joined.withColumn("sampled", draw < F.col("probability"))


def with_topic(docs: DataFrame, vectors: DataFrame, key: str = "doc_id", vec_key: str = "vec_id", label: str = "label", topic: str = "topic") -> DataFrame:
    """``docs`` with the label of the vector of the same id as topic, 'none' without one."""
    docs = without(docs, topic)
    (vid,) = tmp_names(docs.columns, "vec_id")
    labels = vectors.groupBy(F.col(vec_key).alias(vid)).agg(F.min(label).alias(topic))
    return docs.join(labels, docs[key] == labels[vid], "left").drop(vid).withColumn(topic, F.coalesce(F.concat(F.lit("t"), F.col(topic).cast("string")), F.lit("none")))
