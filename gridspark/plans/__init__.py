"""Registered queries; importing this package fills the registry."""

from gridspark.plans import (  # noqa: F401
    evaluation,
    metric_queries,
    puzzle_queries,
    quad_queries,
    stream_queries,
    table_queries,
    vector_queries,
)
from gridspark.plans.registry import COVERS, ORACLES, QUERIES  # noqa: F401
