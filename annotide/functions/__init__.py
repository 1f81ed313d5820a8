"""Column expressions: boxes, polygons, text, geometry."""
