"""barloom: a PySpark-native engine for strategy research on price series."""

__version__ = "0.1.0"
