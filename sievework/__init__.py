"""Table exploration, cleaning and reporting as PySpark DataFrame jobs."""

from sievework.session import build_session

__all__ = ["build_session"]
