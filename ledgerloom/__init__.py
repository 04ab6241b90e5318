"""Ledgerloom: relational data quality, generation, editing and guarded SQL on Spark DataFrames."""
