"""Every operator as a runnable query over the driver tables, with its check SQL."""

from . import (  # noqa: F401
    desk_queries, ingest_queries, match_queries, model_queries, nightly_queries, queue_queries,
    scoring_queries,
)
from .registry import REGISTRY, callable_for

__all__ = ["REGISTRY", "callable_for"]
