import random
import re
from collections import Counter

import numpy as np
from helpers import documents, sentence
from pyspark.sql import functions as F

from simcat.llm import outliers, queries


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered.update(range(i, i + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def brute_stats(c):
    n = max(c[0], 1)
    return [np.log(n), np.log(max(c[1], 1) / n), np.log1p(10 * c[2] / n), np.log1p(10 * c[3] / n), c[4] / n]


def brute_mcd(x, steps=outliers.STEPS):
    """The same concentration steps in numpy; bins as in the operator."""
    floor = np.eye(5) * outliers.FLOOR**2

    def quantile(col, q):
        b = np.sort(np.floor(col * outliers.BINS))
        return (b[int(np.ceil(q * len(b))) - 1] + 0.5) / outliers.BINS

    med, scale = np.array([quantile(c, 0.5) for c in x.T]), np.array([(quantile(c, 0.75) - quantile(c, 0.25)) / 1.349 for c in x.T])
    fits = []
    for m, v in ((med, np.diag(scale**2) + floor), (x.mean(0), np.cov(x.T, bias=True) + floor)):
        for step in range(steps):
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(v), x - m)
            b = np.floor(np.log(d + 1e-9) * outliers.BINS)
            core = x[b <= np.sort(b)[int(np.ceil(outliers.SHARE * len(b))) - 1]]
            m, v = core.mean(0), np.cov(core.T, bias=True) * (outliers.CONSISTENCY if step == steps - 1 else 1) + floor
        fits.append((np.linalg.slogdet(v)[1], m, v))
    _, m, v = min(fits, key=lambda f: round(f[0], 9))
    return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(v), x - m)


def test_counts_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r[0]: tuple(r[1:7]) for r in queries.op9_mcd_quality(spark, sf).collect()}
    for i, t in docs:
        c = brute_counts(t)
        assert got[i] == (*c, c[0] < 20 or 100 * c[4] > 30 * c[0])


def test_repeated_windows(spark):
    rng = random.Random(2)
    part = sentence(rng, 12)
    texts = [part + " x " + part, "a " * 30, "a b c d e f g h " * 3, part, " ".join(map(str, range(9))) + " " + " ".join(map(str, range(9))), "0 1 2 3 4 5 6 7", "p\np\n q\n q\n\n\n \np", *[" ".join(rng.choice("ab") for _ in range(rng.randint(1, 60))) for _ in range(60)]]
    got = {r.doc_id: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in outliers.counts(documents(spark, texts)).collect()}
    assert got == {i: brute_counts(t) for i, t in enumerate(texts)}


def test_verdicts_equal_numpy_and_reject_the_odd(spark):
    rng = random.Random(11)
    texts = []
    for i in range(400):
        t = sentence(rng, int(np.exp(rng.gauss(5, 0.6))) + 20)
        if i % 5 == 0:
            t = t.replace(" ", "## $ ") if i % 2 else t.replace("a", "a|")
        texts.append(t)
    docs = documents(spark, texts).withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string")})
    rows = sorted(outliers.judge(docs).collect(), key=lambda r: r.doc_id)
    counts = [brute_counts(t) for t in texts]
    sound = np.array([not (c[0] < 20 or 100 * c[4] > 30 * c[0]) for c in counts])
    x = np.array([brute_stats(c) for c in counts])[sound]
    want = brute_mcd(x)
    got = np.array([r.distance for r, s in zip(rows, sound) if s])
    assert np.allclose(got, want, rtol=1e-6)
    for r, s in zip(rows, sound):
        assert r.base_failed == (not s) and r.kept == (s and r.distance <= outliers.CUTOFF)
    assert all(r.kept for i, r in enumerate(rows) if i % 5 and not r.base_failed)
    assert sum(not r.kept for i, r in enumerate(rows) if i % 5 == 0) > 60


def test_awkward_rows_small_groups_and_empty(spark):
    docs = documents(spark, extra=True).withColumnsRenamed({"shard": "n", "score": "distance", "t": "s1"})
    out = outliers.judge(docs)
    assert {*out.columns} == {*docs.columns, *outliers.RESULTS} - {"text"}
    rows = out.collect()
    assert len(rows) == docs.count() and all(r.kept == (not r.base_failed) for r in rows)
    assert outliers.judge(documents(spark, [])).count() == 0


def test_the_query_judges_every_sound_row(spark, sf):
    rows = queries.op9_mcd_quality(spark, sf).collect()
    assert all((r.distance is None) == r.base_failed and r.kept == (not r.base_failed and r.distance <= outliers.CUTOFF) for r in rows)
    assert any(not r.kept and not r.base_failed for r in rows)


def test_main_path_has_no_python(spark, sf):
    plan = queries.op9_mcd_quality(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_odd_rows_of_small_groups_are_rejected_by_their_pool(spark):
    rng = random.Random(12)
    normal = [sentence(rng, int(np.exp(rng.gauss(5, 0.3))) + 20) for _ in range(190)]
    odd = sentence(rng, 80).replace(" ", "## $ ")
    groups = [("en", "big")] * 100 + [("de", f"small{i % 16}") for i in range(80)] + [("fr", None)] * 4 + [(None, "none")] * 4 + [("xx", "y")] * 2
    rows = [(i, t, *g) for i, (t, g) in enumerate(zip(normal, groups))]
    rows += [(1000, odd, "en", "big"), (1001, odd, "de", "small3"), (1002, odd, "fr", None), (1003, odd, None, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in outliers.judge(docs, pools=[["lang"], []]).collect()}
    assert len(got) == len(rows) and all(r.distance is not None for r in got.values())
    assert not any(got[i].kept for i in range(1000, 1004))
    assert all(r.kept for i, r in got.items() if i < 1000)
    # each by the estimate of its own group, its language or all rows
    for want in (lambda r: r[2:] == ("en", "big"), lambda r: r[2] == "de", lambda r: True):
        part = [r for r in rows if want(r)]
        own = part if len(part) < len(rows) else [r for r in rows if r[2] not in ("en", "de")]
        d = dict(zip([r[0] for r in part], brute_mcd(np.array([brute_stats(brute_counts(r[1])) for r in part]))))
        assert np.allclose([got[r[0]].distance for r in own], [d[r[0]] for r in own], rtol=1e-6)
