"""All registered queries and their oracles."""

from __future__ import annotations

from terrascore.plans import (queries_eval, queries_model, queries_prep,  # noqa: F401
                              queries_score, queries_select)
from terrascore.plans.registry import ORACLE, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
