"""Queries over the test tables, with the SQL they are checked against."""


def load_all():
    """Import every plan module and return (queries, oracles)."""
    from . import ingested, products, radiometry, records, scores, terrain  # noqa: F401
    from .registry import ORACLES, QUERIES
    return QUERIES, ORACLES
