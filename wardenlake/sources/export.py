"""Report and graph export as JSON rows."""

from __future__ import annotations

from pyspark.sql import DataFrame


def export_report(rows: DataFrame, path: str, fmt: str = "json") -> None:
    if fmt != "json":
        raise ValueError(f"unsupported format: {fmt}")
    rows.write.mode("overwrite").json(path)


def export_graph(nodes: DataFrame, links: DataFrame, waves: DataFrame, path: str) -> None:
    """Three row sets under one folder."""
    for name, frame in (("nodes", nodes), ("links", links), ("waves", waves)):
        export_report(frame, f"{path}/{name}")
