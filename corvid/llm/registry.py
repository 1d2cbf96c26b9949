"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from corvid.llm import q_dedup, q_filters, q_model, q_packing, q_structure

QUERIES = {}
ORACLE = {}
for _module in (q_dedup, q_filters, q_model, q_packing, q_structure):
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
