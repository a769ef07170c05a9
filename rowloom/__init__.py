"""rowloom: a PySpark-native engine that turns web material into clean, exportable rows."""

__version__ = "0.1.0"
