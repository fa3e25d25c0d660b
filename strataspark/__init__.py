"""Cohort, stratified-rate and survival analytics as plain Spark plans.

Every operator takes DataFrames or Columns and returns DataFrames or Columns.
Nothing here defines a UDF: the optimizer sees each plan from scan to result.
"""

__version__ = "0.1.0"
