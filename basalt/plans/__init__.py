"""Queries by operator and by workload; importing a module registers its queries."""

from . import clickbench, operators, shapes, tpch

__all__ = ["clickbench", "operators", "shapes", "tpch"]
