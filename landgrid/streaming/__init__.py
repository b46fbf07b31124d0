"""Category statistics over streams."""
