"""The registered queries of this subpackage and the SQL that must give the same rows."""

from __future__ import annotations

from hearsay.llm import (
    extraction, jaccard, licences, lm, mixing, neardup, packing, sharding, substrings, topk, toxicity, turns, whitening,
)

MODULES = (topk, neardup, packing, substrings, jaccard, lm, toxicity, mixing, licences, extraction, sharding, whitening, turns)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
