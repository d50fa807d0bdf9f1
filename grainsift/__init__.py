"""grainsift: data profiling, rule checking, cleaning and quality scoring on Spark.

Every operator takes DataFrames and returns DataFrames (or plain Columns), so the
pieces combine freely with ordinary Spark code.
"""

__version__ = "0.1.0"
