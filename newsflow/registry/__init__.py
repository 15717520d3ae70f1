"""Registered queries and their SQL forms."""


def load():
    """(queries, oracles) by name."""
    from newsflow.registry import base, model_queries, price_queries, stream_queries, table_queries, text_queries  # noqa: F401

    return base.QUERIES, base.ORACLES
