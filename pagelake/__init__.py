"""pagelake: web-page indexing, safety and search as Spark DataFrame jobs."""

from pagelake.config import DEFAULT, Settings

__all__ = ["DEFAULT", "Settings"]
