"""Whole queries over the analytics tables, each with its SQL counterpart."""

from faultline.plans import (  # noqa: F401  (importing registers the queries)
    alerts,
    code,
    logs,
    quality,
    sources,
    streams,
    telemetry,
    triage,
)
from faultline.plans.registry import QUERIES, checks

__all__ = ["QUERIES", "checks"]
