"""All registered queries: name -> (builder(spark, sf_dir) -> DataFrame, oracle SQL or None)."""

from __future__ import annotations

from simcat.plans import catalog_queries, load_queries, search_queries, stream_queries, text_queries

ALL: dict = {}
for _mod in (search_queries, text_queries, load_queries, catalog_queries, stream_queries):
    ALL.update(_mod.QUERIES)

FLAGSHIP = search_queries.search_text_topk
