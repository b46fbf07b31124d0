"""Operators on feature tables: access, statistics, spatial index and joins, overlay jobs, keyword search."""
