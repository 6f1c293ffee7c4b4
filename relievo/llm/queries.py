"""All registered queries of this subpackage."""


def load_all():
    """Import every operator module and return (queries, oracles)."""
    from . import (  # noqa: F401
        bpe, divergence, hard_negatives, jaccard_join, packing, pii, quality, sharding, simhash, substring_dedup, suffix_dedup,
        token_counts, topk)
    from .common import ORACLES, QUERIES
    return QUERIES, ORACLES
