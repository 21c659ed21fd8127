"""Queries over the driver tables, one or more for each operator."""

from pitchspark.plans import analytics, market_queries, model_queries, relational, result_queries, scalar_queries, study_queries  # noqa: F401  registers its queries
from pitchspark.plans.registry import ORACLE_SQL, QUERIES, runner  # noqa: F401
