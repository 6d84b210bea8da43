"""Cutting lineage in storage that outlives executors, as the rest of the library does it."""

from leafmill.functions.lineage import cut_lineage

__all__ = ["cut_lineage"]
