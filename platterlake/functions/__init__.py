"""Column expressions: sizes, names, dates, digests and bitmaps."""
