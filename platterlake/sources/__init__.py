"""Readers of images, partition tables, containers, filesystems and archives."""
