"""Readers of the engine's input relations."""

from leafmill.sources.tables import read_table

__all__ = ["read_table"]
