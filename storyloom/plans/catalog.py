"""All registered queries: importing the query modules fills the registry."""

import storyloom.plans.listing_queries
import storyloom.plans.metric_queries
import storyloom.plans.scalar_queries
import storyloom.plans.story_queries
import storyloom.plans.stream_queries
import storyloom.plans.table_queries  # noqa: F401
from storyloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
