"""Named queries. Importing this package registers every query module."""

from tankline.plans import (cluster_queries, density_queries, eval_queries, flag_queries, io_queries,  # noqa: F401
                            model_queries, sweep_queries, table_queries)
from tankline.plans.registry import REGISTRY, Query, query

__all__ = ["REGISTRY", "Query", "query"]
