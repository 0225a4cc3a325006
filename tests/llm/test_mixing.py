import struct

import numpy as np
import pytest
import xxhash
from helpers import documents

from simcat.llm import mixing, queries

MARGINS = ["source", "lang", "n_chars"]


def ipf(cells, margins, targets, rounds):
    w = {k: float(v) for k, v in cells.items()}
    for _ in range(rounds):
        for m in range(margins):
            total = {}
            for k, v in w.items():
                total[k[m]] = total.get(k[m], 0) + v
            w = {k: v * targets[m][k[m]] / total[k[m]] for k, v in w.items()}
    s = sum(w.values())
    return {k: v / s for k, v in w.items()}


def test_raked_weights_match_brute_force_and_targets(spark):
    rng = np.random.default_rng(3)
    rows = [(f"s{i % 5}", "l" + str(i % 7 % 3), i % 2, int(rng.integers(1, 900))) for i in range(400)]
    cells = {}
    for s, la, t, n in rows:
        cells[s, la, t] = cells.get((s, la, t), 0) + n
    df = spark.createDataFrame(rows, "source string, lang string, topic int, n_tokens long")
    counted = mixing.cell_counts(df, ["source", "lang", "topic"], "n_tokens")
    raked = mixing.rake(counted, ["source", "lang", "topic"], "n_tokens", power=0.5, rounds=20)
    got = mixing.sampling_rates(raked, "n_tokens").collect()
    total = sum(cells.values())
    targets = []
    for m in range(3):
        had = {}
        for k, v in cells.items():
            had[k[m]] = had.get(k[m], 0) + v
        goal = {k: (v / total) ** 0.5 for k, v in had.items()}
        targets.append({k: v / sum(goal.values()) for k, v in goal.items()})
    want = ipf(cells, 3, targets, 20)
    ratio = {k: want[k] / cells[k] for k in cells}
    for r in got:
        k = (r.source, r.lang, r.topic)
        assert r.weight == pytest.approx(want[k], rel=1e-9)
        assert r.probability == pytest.approx(ratio[k] / max(ratio.values()), rel=1e-9)
    for m, name in enumerate(("source", "lang", "topic")):
        for value, goal in targets[m].items():
            assert sum(r.weight for r in got if r[name] == value) == pytest.approx(goal, rel=1e-3)


def test_given_targets_hold_in_the_sample(spark):
    rows = [(i, "word " * (1 + i % 5), "en" if i % 10 else "de", f"s{i // 10 % 2}") for i in range(20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    share = spark.createDataFrame([("en", 0.5), ("de", 0.5)], "lang string, share double")
    out = mixing.mix(docs, ["lang", "source"], power={"lang": 1.0, "source": 1.0}, targets={"lang": share}).filter("sampled").collect()
    de = sum(r.n_tokens for r in out if r.lang == "de") / sum(r.n_tokens for r in out)
    assert abs(de - 0.5) < 0.03
    assert all(abs(r.probability - 1) < 1e-9 for r in out if r.lang == "de")


def test_awkward_rows_are_drawn_alike_and_keep_their_columns(spark):
    docs = documents(spark, extra=True).withColumnRenamed("score", "weight")
    out = mixing.mix(docs, ["source", "lang"])
    assert set(out.columns) == {*docs.columns, "n_tokens", "probability", "sampled"}
    rows = out.collect()
    assert len(rows) == docs.count() and all(r.probability is not None and 0 < r.probability <= 1 for r in rows)
    assert len({r.sampled for r in rows if r.doc_id == 5}) == 1
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs, ["source", "lang"]).collect()))


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert mixing.mix(empty, ["source", "lang"]).count() == 0


def test_topics_do_not_multiply_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (3, "d")], "doc_id long, topic string")
    vectors = spark.createDataFrame([(1, 4), (1, 2), (9, 1), (None, 5)], "vec_id long, label int")
    out = mixing.with_topic(docs, vectors)
    assert sorted(r.topic for r in out.collect()) == ["none", "none", "t2", "t2"]


def corpus(rng, n=4000):
    """(id, text, lang, source): skewed, every cell large."""
    return [(i, "word " * int(rng.integers(5, 60)), ["en", "en", "en", "de"][i % 4], f"s{int(rng.integers(3)) ** 2 // 2}") for i in range(n)]


DOCS = "doc_id long, text string, lang string, source string"


def test_a_budget_is_met_and_strays_move_only_themselves(spark):
    rng = np.random.default_rng(5)
    rows = corpus(rng)
    strays = [(10**6, "word " * 50, "xx", "s0"), (10**6 + 1, "word " * 50, "en", "rare"), (10**6 + 2, "word " * 50, "yy", "new")]
    kept = {}
    for name, table in (("plain", rows), ("strays", rows + strays)):
        out = mixing.mix_to_budget(spark.createDataFrame(table, DOCS), ["source", "lang"]).collect()
        total = sum(r.n_tokens for r in out)
        assert len(out) == len(table) and all(0 < r.probability <= 1 for r in out)
        assert sum(r.n_tokens * r.probability for r in out) == pytest.approx(mixing.KEEP * total, rel=1e-9)
        assert sum(r.n_tokens for r in out if r.sampled) == pytest.approx(mixing.KEEP * total, rel=0.03)
        kept[name] = {r.doc_id: r.probability for r in out}
    assert all(abs(kept["strays"][i] / p - 1) < 0.02 for i, p in kept["plain"].items())


def test_shares_within_a_budget_equal_brute_force(spark):
    rows = corpus(np.random.default_rng(6))
    budget = 0.5 * sum(len(t.split()) for _, t, _, _ in rows)
    out = mixing.mix_to_budget(spark.createDataFrame(rows, DOCS), ["source", "lang"], budget=budget, power=0.7, rounds=20).collect()
    cells = {}
    for _, t, la, s in rows:
        cells[s, la] = cells.get((s, la), 0) + len(t.split())
    targets = []
    for m in range(2):
        had = {}
        for k, v in cells.items():
            had[k[m]] = had.get(k[m], 0) + v
        goal = {k: (v / sum(cells.values())) ** 0.7 for k, v in had.items()}
        targets.append({k: v / sum(goal.values()) for k, v in goal.items()})
    want = {k: v * budget for k, v in ipf(cells, 2, targets, 20).items()}
    assert all(w < cells[k] for k, w in want.items())
    assert all(r.weight == pytest.approx(want[r.source, r.lang], rel=1e-6) and r.probability == pytest.approx(want[r.source, r.lang] / cells[r.source, r.lang], rel=1e-6) for r in out)


def test_a_target_beyond_its_documents_takes_all_of_them(spark):
    rows = corpus(np.random.default_rng(7))
    share = spark.createDataFrame([("en", 0.1), ("de", 0.9)], "lang string, share double")
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.mix_to_budget(docs, ["lang"], targets={"lang": share}).collect()
    total = sum(r.n_tokens for r in out)
    assert all(r.probability == pytest.approx(1, abs=1e-9) for r in out if r.lang == "de")
    assert sum(r.n_tokens * r.probability for r in out) == pytest.approx(mixing.KEEP * total, rel=1e-9)
    assert all(r.sampled for r in mixing.mix_to_budget(docs, ["lang"], budget=2 * total).collect())
    assert mixing.mix_to_budget(docs.limit(0), ["source", "lang"]).count() == 0
    awkward = mixing.mix_to_budget(documents(spark, extra=True), ["source", "lang"]).collect()
    assert len(awkward) == documents(spark, extra=True).count() and all(0 < r.probability <= 1 for r in awkward)


def fill(wanted, most, budget):
    """The factor for which the sum of min(most, factor * wanted) is the budget, by bisection."""
    if sum(most) <= budget:
        return float("inf")
    low, high = 0.0, max(m / w for m, w in zip(most, wanted))
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(m, mid * w) for m, w in zip(most, wanted)) < budget else (low, mid)
    return high


def brute_mix(rows, seed=mixing.SEED):
    """{id: (probability, sampled)} of (id, n_tokens, (source, lang, topic)) rows: the default mix to a budget."""
    cells = {}
    for _, n, k in rows:
        cells[k] = cells.get(k, 0) + n
    total = sum(cells.values())
    budget, free, goals = mixing.KEEP * total, {}, []
    for m in range(3):
        had = {}
        for k, n in cells.items():
            if not (m == 2 and k[m] == "none"):
                had[k[m]] = had.get(k[m], 0) + n
        wanted = {v: (n / total) ** mixing.POWER for v, n in had.items()}
        c = fill(list(wanted.values()), list(had.values()), budget * sum(had.values()) / total)
        goals.append({v: min(had[v], c * w) for v, w in wanted.items()})
    free = {k: budget / total * n for k, n in cells.items()}
    for _ in range(mixing.ROUNDS):
        for m, goal in enumerate(goals):
            sums = {}
            for k, w in free.items():
                sums[k[m]] = sums.get(k[m], 0) + min(w, cells[k])
            free = {k: w * (goal[k[m]] / sums[k[m]] if k[m] in goal else 1) for k, w in free.items()}
    c = fill(list(free.values()), list(cells.values()), budget)
    rate = {k: min(cells[k], c * w) / cells[k] for k, w in free.items()}
    first = xxhash.xxh64_intdigest(struct.pack("<q", seed), seed=42)
    draw = lambda i: ((xxhash.xxh64_intdigest(struct.pack("<q", i), seed=first) >> 11) + 0.5) / (1 << 53)
    return {i: (rate[k], draw(i) < rate[k]) for i, _, k in rows}


def test_query_equals_brute_force(spark, sf):
    rows = queries.op2_mix_to_targets(spark, sf).collect()
    want = brute_mix([(r.doc_id, r.n_tokens, (r.source, r.lang, r.topic)) for r in rows])
    assert len(want) == len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.probability == pytest.approx(want[r.doc_id][0], abs=2e-9) and r.sampled == want[r.doc_id][1] for r in rows)


def test_rows_of_unknown_topic_are_drawn_as_often_as_the_others(spark):
    rows = corpus(np.random.default_rng(8))
    docs = spark.createDataFrame(rows, DOCS)
    vectors = spark.createDataFrame([(i, 0 if i % 3 else i % 4) for i in range(0, len(rows), 5)], "vec_id long, label int")
    out = mixing.mix_to_budget(mixing.with_topic(docs, vectors), ["source", "lang", "topic"], budget=50000, unknown={"topic": "none"}).collect()

    def mean(of):
        return sum(r.probability * r.n_tokens for r in of) / sum(r.n_tokens for r in of)

    none, known = [r for r in out if r.topic == "none"], [r for r in out if r.topic != "none"]
    assert len(none) == 4 * len(known)
    assert mean(none) == pytest.approx(mean(known), rel=0.02)
    # the topics that are known still have their tempered shares
    total = sum(r.n_tokens for r in known)
    goal = {t: (sum(r.n_tokens for r in known if r.topic == t) / total) ** mixing.POWER for t in {r.topic for r in known}}
    drawn = sum(r.n_tokens * r.probability for r in known)
    for t, g in goal.items():
        assert sum(r.n_tokens * r.probability for r in known if r.topic == t) / drawn == pytest.approx(g / sum(goal.values()), rel=0.02)
