"""All registered queries and their oracle SQL."""

from attestry.queries import (  # noqa: F401
    evidence_layer,
    metrics_layer,
    scoring_layer,
    streaming_layer,
    text_layer,
)
from attestry.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
