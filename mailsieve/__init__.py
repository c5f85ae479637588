"""Mail-spam analytics as set-based Spark jobs."""

from mailsieve.config import EngineConfig

__all__ = ["EngineConfig"]
