"""All queries over the driver's tables."""

from __future__ import annotations

from quartzgrid.catalog import merged
from quartzgrid.plans import grids, models, retrieval, versions, workbooks

FLAGSHIP = "lex_match_topk"
CATALOG = merged(retrieval.CATALOG, grids.CATALOG, versions.CATALOG, workbooks.CATALOG, models.CATALOG)
