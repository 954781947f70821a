"""Basalt: an analytics engine that plans with Spark and answers like a columnar SQL database."""

from .catalog import load_tables, table
from .engine import Engine
from .session import build_session

__all__ = ["Engine", "build_session", "load_tables", "table"]
