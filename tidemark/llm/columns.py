"""Names for columns that are added for a while."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, behind as many underscores as keep them apart from the frame's own columns (which Spark compares without case)."""
    taken, lead = {c.lower() for c in docs.columns}, "__"
    while any(f"{lead}{n}".lower() in taken for n in names):
        lead += "_"
    return [f"{lead}{n}" for n in names]
