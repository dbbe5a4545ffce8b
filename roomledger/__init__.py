"""Room utilisation reporting for school districts, as Spark DataFrame jobs."""

from roomledger.config import Rules

__all__ = ["Rules"]
