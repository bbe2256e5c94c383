"""photocat: PySpark operators over photo archive catalogues (DataFrames in, DataFrames out)."""

__version__ = "0.1.0"
