"""corpuscle: a PySpark-native analytics engine for scientific-literature corpora."""

__version__ = "0.1.0"
