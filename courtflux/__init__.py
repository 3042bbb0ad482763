"""courtflux: a PySpark-native engine for frame-indexed sports-tracking tables."""

__version__ = "0.1.0"
