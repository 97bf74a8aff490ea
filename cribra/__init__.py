"""cribra: generate-verify-select table jobs on Spark DataFrames."""

__version__ = "0.1.0"
