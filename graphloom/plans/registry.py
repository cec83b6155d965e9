"""All queries outside the subpackage ``llm``."""

from __future__ import annotations

from graphloom.plans import evidence, feeds, graph, hybrid, readers, retrieval, training

MODULES = [evidence, feeds, graph, hybrid, readers, retrieval, training]


def queries() -> dict:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def sql() -> dict[str, str]:
    return {name: text for module in MODULES for name, text in module.SQL.items()}
