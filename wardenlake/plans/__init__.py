"""Registered queries by family."""

from importlib import import_module

from wardenlake.plans.registry import ORACLES, QUERIES

for _family in ["scan", "mask", "lineage", "audit", "code", "risk", "graph", "snapshot", "rollout", "finance",
                "retrieval", "catalog", "source"]:
    import_module(f"wardenlake.plans.{_family}_queries")

__all__ = ["ORACLES", "QUERIES"]
