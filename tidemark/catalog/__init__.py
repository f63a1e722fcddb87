"""Named queries over the test tables and the SQL they are checked against."""


def load():
    """(queries, checking SQL) of all families."""
    from tidemark.catalog import corpus, knowledge, plans, storage, streams, telemetry, usage  # noqa: F401
    from tidemark.catalog.registry import ORACLE, QUERIES

    return QUERIES, ORACLE
