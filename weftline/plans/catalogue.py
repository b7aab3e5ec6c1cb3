"""The registered queries and their SQL."""

from weftline.plans import cluster_queries, evidence_queries, lifecycle_queries, serving_queries, spatial_queries, text_queries  # noqa: F401
from weftline.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
