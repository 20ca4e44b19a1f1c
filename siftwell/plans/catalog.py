"""All registered queries of the core."""

from siftwell.plans import feeds, retrieval, texts, upkeep

_MODULES = [texts, retrieval, upkeep, feeds]


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _MODULES for k, v in m.ORACLE.items()}
