"""All registered queries; importing a section registers its entries."""

from tonemark.plans import (  # noqa: F401
    check_queries,
    group_queries,
    label_queries,
    metric_queries,
    model_queries,
    source_queries,
    stream_queries,
)
from tonemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
