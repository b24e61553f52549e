"""Query registry used by the driver entry point, bench and tests."""

from .bindings import QUERIES
from .oracle import ORACLE

__all__ = ["QUERIES", "ORACLE"]
