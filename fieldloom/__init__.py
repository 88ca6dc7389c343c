"""fieldloom: study tables, mesh fields and labels as Spark DataFrames.

The package is a thin library of DataFrame plans.  It holds no execution
engine of its own: every operator is expressed with the DataFrame API and
leaves the physical strategy to Spark.
"""

__version__ = "0.1.0"
