"""srcatlas: a PySpark-native engine for collections of text and source code."""

__version__ = "0.1.0"
