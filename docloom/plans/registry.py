"""All registered queries and their SQL twins, outside the training-data subpackage."""

from __future__ import annotations

from docloom.plans import flows, learning, logs, pages, reports, retrieval, study, texts
from docloom.plans.support import Query

MODULES = (pages, texts, reports, logs, retrieval, study, learning, flows)
QUERIES: dict[str, Query] = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: q for m in MODULES for name, q in m.ORACLES.items()}
