"""Readers of feature records, JSON, shape files and rasters, and writers of tables, text, shape files and archives."""
