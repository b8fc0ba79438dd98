"""Spark-native analytics: tabular, spatial and raster operators as DataFrame jobs."""
