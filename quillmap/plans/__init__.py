from quillmap.plans import extraction_queries, search_queries, store_queries  # noqa: F401
from quillmap.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
