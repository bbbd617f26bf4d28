"""Deterministic plate-cutting tables derived from the driver's parquet tables."""
