"""Column functions: codes, grids, map sheets, measures, projections, text and geometry."""
