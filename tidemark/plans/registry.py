"""Queries of the engine's own operators, by name, and their SQL oracles."""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers fn(spark, sf_dir) -> DataFrame; sql computes the same rows elsewhere."""

    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def queries() -> dict:
    from . import color_queries, queries, source_queries  # noqa: F401  registers them

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import color_queries, queries, source_queries  # noqa: F401

    return dict(ORACLES)
