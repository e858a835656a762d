"""textlens: labelled-text analytics on Spark DataFrames.

Every operator takes DataFrames and parameters and returns a lazy DataFrame (or a
Column expression); Catalyst chooses the physical plan.
"""

__version__ = "0.1.0"
