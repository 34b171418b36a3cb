"""All registered queries of the mail engine, and the SQL that must agree with them."""

from __future__ import annotations

from . import queries

QUERIES = dict(queries.QUERIES)
ORACLES = dict(queries.ORACLES)


def flagship(spark, sf_dir: str):
    return queries.page_verdicts(spark, sf_dir).select("message_id", "score", "tier", "headline")
