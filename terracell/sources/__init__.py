"""Readers and writers: Parquet tables, GeoJSON, delimited indicators, file listings, and binary raster and vector files.

Binary files come through Spark's ``binaryFile`` reader, so they can be in any store that Spark reads; a file is
decoded by one task with numpy.
"""
