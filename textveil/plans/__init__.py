"""Queries of the engine's own operators."""


def queries() -> dict:
    from textveil.plans.catalogue import QUERIES

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from textveil.plans.catalogue import SQL

    return dict(SQL)
