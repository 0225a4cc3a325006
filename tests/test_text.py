"""Row expressions against plain Python written from the spec (P-1..P-9, P-12)."""

import random
import re

from pyspark.sql import functions as F

from simcat.functions import text as T
from simcat.functions.vector import round_score

WS = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())


def py_clean(desc, cap=2000):
    d = desc.strip()
    if not d:
        return ""
    d = re.sub(r"<[^>]+>", " ", d)
    d = re.sub(r"\s+", " ", d).strip()
    return d[:cap]


def test_strip_matches_python(spark):
    rnd = random.Random(7)
    pool = list(WS) + list("ab é\U0001F600​﻿")
    samples = ["", WS, " x ", WS + "a b" + WS] + [
        "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 10))) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(samples)), "i int, s string")
    got = {r.i: r.t for r in df.select("i", T.py_strip("s").alias("t")).collect()}
    assert all(got[i] == s.strip() for i, s in enumerate(samples))
    blank = {r.i: r.b for r in df.select("i", T.is_blank("s").alias("b")).collect()}
    assert all(blank[i] == (s.strip() == "") for i, s in enumerate(samples))


def test_clean_description_matches_python_on_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    extra = spark.createDataFrame([(-1, "<p>Warm&nbsp;light</p>\n<b>new</b>"), (-2, "  <br/> "),
                                   (-3, "a  b<i\n>c"), (-4, "x" * 2500 + "\U0001F600")],
                                  "page_id long, html string")
    df = pages.select("page_id", "html").unionByName(extra)
    rows = df.select("page_id", "html", T.clean_description("html").alias("c")).collect()
    assert rows
    for r in rows:
        assert r.c == py_clean(r.html), r.page_id


def test_category_path_and_attributes(spark):
    rows = [("Home", "Home", "Light", "Lamps"), ("", None, "A", "A"), (None, None, None, None), ("x", "y", "x", "z")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    got = [r.p for r in df.select(T.category_path("a", "b", "c", "d").alias("p")).collect()]

    def py(vals):
        out = []
        for v in vals:
            if v and v not in out:
                out.append(v)
        return " > ".join(out)

    assert got == [py(r) for r in rows]
    a = spark.createDataFrame([(["E27", "60"],), ([],), (None,), ([str(i) for i in range(15)],)], "l array<string>")
    got = [r.t for r in a.select(T.attribute_list("l").alias("t")).collect()]
    assert got == ["E27; 60", None, None, "; ".join(str(i) for i in range(10))]


def test_rating_text(spark):
    raw = ["4.5", "5", "0", "-1", "NaN", "4.50", None, "abc", "1e2", "0.0"]
    df = spark.createDataFrame([(r,) for r in raw], "r string")
    got = [x.t for x in df.select(T.rating_text("r").alias("t")).collect()]
    assert got == ["4.5", "5", None, None, None, "4.5", None, None, "100.0", None]


def test_product_text_worked_example(spark):
    df = spark.createDataFrame([(" Lamp ", "Home", "Home", "Light", "Lamps", "<p>Warm&nbsp;light</p>\n<b>new</b>",
                                 ["E27", "60"], "Acme", "4.5")],
                               "title string, g string, gp string, p string, c string, d string, "
                               "a array<string>, s string, r string")
    text = T.product_text("title", T.category_path("g", "gp", "p", "c"), T.clean_description("d"),
                          T.attribute_list("a"), "s", T.rating_text("r"))
    got = df.select(text.alias("t")).first().t
    assert got == ("Название: Lamp | Категории: Home > Light > Lamps | Описание: Warm&nbsp;light new | "
                   "Характеристики: E27; 60 | Продавец: Acme | Рейтинг: 4.5")
    empty = spark.createDataFrame([(" ", None, None, None, None, "  ", None, " ", "0")], df.schema)
    assert empty.select(text.alias("t")).first().t == ""


def test_round_half_even_like_python(spark):
    vals = [0.03125, 0.00015, 0.00025, -0.00035, 1.0000003, 0.99995, 0.12345, -1.0000002]
    df = spark.createDataFrame([(v,) for v in vals], "s double")
    got = [r.x for r in df.select(round_score("s", 4).alias("x")).collect()]
    assert got == [max(-1.0, min(1.0, round(v, 4))) for v in vals]


def test_preview_and_ack(spark):
    df = spark.createDataFrame([(7, "x" * 200, "inserted")], "id long, t string, a string")
    r = df.select(T.preview("t", 150).alias("p"), T.ack_message("id", "a").alias("m")).first()
    assert r.p == "x" * 150 + "..." and r.m == "Upserted (ID: 7, inserted)"


def test_py_round_property(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from simcat.functions.vector import py_round

    collected = []

    @settings(max_examples=300, deadline=None)
    @given(st.one_of(st.floats(-2, 2, allow_nan=False), st.integers(-99999, 99999).map(lambda i: i / 20000)),
           st.integers(0, 8))
    def gather(x, n):
        collected.append((x, n))

    gather()
    df = spark.createDataFrame([(i, x, n) for i, (x, n) in enumerate(collected)], "i long, x double, n int")
    # one expression per n (the number of decimals is a plan constant)
    for n in range(9):
        part = df.filter(F.col("n") == n).select("i", "x", py_round("x", n).alias("r")).collect()
        assert all(r.r == round(r.x, n) for r in part), n
