"""Disk-image analytics as DataFrames: catalogs, diffs, digests, integrity checks, layouts and rates."""
