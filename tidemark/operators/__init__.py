"""DataFrame operators: joins, aggregates and windows keyed by ``db_id``."""
