"""All named queries."""

from eccentra.plans import q_aggregate, q_join, q_ordered, q_points, q_projection, q_source, q_stats, q_stream  # noqa: F401
from eccentra.plans.registry import ORACLES, QUERIES  # noqa: F401
