"""Registered queries over the driver's tables."""

from . import (  # noqa: F401
    bundle_queries, file_queries, page_queries, scan_queries, sourcemap_queries, site_queries, store_queries, stream_queries, text_queries,
)
from .registry import ORACLES, QUERIES  # noqa: F401
