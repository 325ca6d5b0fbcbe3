"""Spark-first engine for point clouds, tile hierarchies and the tables around them."""
