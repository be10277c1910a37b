"""Operators on training-data corpora, and their queries."""

from . import decontaminate, jaccard, licenses, mixing, nearest, personal, quality, ranking, repair, search, secrets, substrings, toxicity

MODULES = [quality, decontaminate, search, jaccard, mixing, personal, secrets, toxicity, licenses, substrings, ranking, repair, nearest]
QUERIES = {name: plan for m in MODULES for name, plan in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
