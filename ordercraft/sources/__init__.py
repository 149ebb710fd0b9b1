"""Inputs and outputs: fixture views over the test tables, CSV export scans,
side-table readers and sinks."""

from .fixtures import Tables, tables

__all__ = ["Tables", "tables"]
