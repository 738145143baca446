"""ledgerlake: receivables, payables and cash-position analytics on Spark DataFrames."""

__version__ = "0.1.0"
