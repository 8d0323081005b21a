"""Spark jobs that organise large document collections."""

from filewright.settings import Run, Settings

__all__ = ["Run", "Settings"]
