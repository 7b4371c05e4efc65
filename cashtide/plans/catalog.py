"""All registered queries and oracles."""

from cashtide.plans import daily_queries, ledger_queries, stream_queries, tree_queries

_MODULES = [ledger_queries, daily_queries, stream_queries, tree_queries]


def queries():
    return {name: fn for module in _MODULES for name, fn in module.QUERIES.items()}


def oracle_sql():
    return {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
