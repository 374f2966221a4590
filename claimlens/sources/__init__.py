"""Readers, writers and small file formats."""

from claimlens.sources.tables import load, shared_dir  # noqa: F401
