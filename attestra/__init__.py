"""attestra: traceability and evidence reconciliation for many projects, as Spark DataFrame plans.

Every operator is a function from DataFrames to a DataFrame. Nothing is collected, nothing is
cached implicitly and no Python code runs per row.
"""

__version__ = "0.1.0"
