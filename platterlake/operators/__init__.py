"""Operators over catalogs, partitions, blocks and backups."""
