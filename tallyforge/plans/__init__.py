"""Registered queries."""

from tallyforge.plans import corpus, evaluation, ledgers, store, mechanisms, routers, scores, texts, trajectories, audits, trees  # noqa: F401
from tallyforge.plans.registry import QUERIES, SQL  # noqa: F401
