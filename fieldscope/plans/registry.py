"""All registered queries and their oracle SQL."""

from importlib import import_module

MODULES = ["trace_queries", "diff_queries", "field_queries", "bit_queries", "planning_queries", "feature_queries", "truth_queries", "source_queries"]


def load() -> tuple[dict, dict]:
    queries, oracles = {}, {}
    for name in MODULES:
        m = import_module(f"fieldscope.plans.{name}")
        clash = set(queries) & set(m.QUERIES)
        if clash:
            raise ValueError(f"query registered twice: {sorted(clash)}")
        queries.update(m.QUERIES)
        oracles.update(m.ORACLES)
    return queries, oracles
