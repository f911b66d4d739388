"""Registered queries over the driver's tables and the SQL that checks them."""

from __future__ import annotations

from gleanworks.plans import analytics, corpus, judging, passages  # noqa: F401  the others register into passages' tables

QUERIES = dict(passages.QUERIES)
ORACLES = dict(passages.ORACLES)
