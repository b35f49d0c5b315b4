"""All registered queries: name -> (Spark query, SQL twin or None)."""
from __future__ import annotations

from beaconry.plans import catalog_eval, catalog_graph, catalog_report, catalog_star, catalog_store, catalog_stream, catalog_text

QUERIES: dict = {}
for _module in (catalog_text, catalog_store, catalog_graph, catalog_star, catalog_eval, catalog_report, catalog_stream):
    QUERIES.update(_module.QUERIES)
