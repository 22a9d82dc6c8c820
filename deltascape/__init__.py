"""Deltascape: two-date change analytics over tiles and polygons, expressed as Spark plans."""
