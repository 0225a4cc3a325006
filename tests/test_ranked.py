"""Pages by rank (S-4)."""

import pytest

from simcat.sources.ranked import build_ranked


def test_pages_equal_a_sort_and_read_two_files_at_most(spark):
    cat = spark.range(5, 1005, 3).selectExpr("id", "concat('t', id) as text").repartition(7)
    ids = sorted(r.id for r in cat.collect())
    ranked = build_ranked(cat, file_rows=40)
    files = ranked.index().collect()
    assert len(files) > 5 and sum(r.n for r in files) == len(ids)
    for offset in (0, 1, len(ids) // 2, len(ids) - 3, len(ids), len(ids) + 5):
        page = ranked.page(10, offset)
        assert [r.id for r in page.collect()] == ids[offset : offset + 10]
        assert len(page.inputFiles()) <= 2
    assert [r.id for r in ranked.page(len(ids), 0).collect()] == ids and ranked.page(0, 5).count() == 0
    with pytest.raises(ValueError):
        ranked.page(5, -1)


def test_an_empty_catalog_has_empty_pages(spark):
    ranked = build_ranked(spark.range(0).selectExpr("id", "'x' as text"))
    assert ranked.page(10, 0).count() == 0 and ranked.page(10, 0).columns == ["id", "text"]
