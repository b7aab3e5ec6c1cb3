"""weftline: an analytics engine for dated notices, expressed on Spark DataFrames."""

__version__ = "0.1.0"
