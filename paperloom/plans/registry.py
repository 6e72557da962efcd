"""Queries by name, with the DuckDB SQL that gives the same rows."""

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) as a query; {views} in sql is replaced by the shared views."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put
