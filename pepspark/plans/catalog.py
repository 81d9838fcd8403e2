"""All registered queries; importing this module fills the registry."""

from . import (  # noqa: F401
    curation_queries,
    descriptor_queries,
    metric_queries,
    sampling_queries,
    scoring_queries,
    similarity_queries,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
