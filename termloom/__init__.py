"""termloom: lexical retrieval and index maintenance as plain Spark DataFrames."""

__version__ = "0.1.0"
