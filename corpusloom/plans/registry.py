"""All registered queries outside the llm subpackage."""

from __future__ import annotations

from corpusloom.plans import problems, reference, reference_evidence, reference_more, reference_tables, reference_texts

MODULES = [problems, reference, reference_more, reference_texts, reference_evidence, reference_tables]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
