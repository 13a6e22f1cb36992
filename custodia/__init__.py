"""Governed analytics on Spark: reports, masking, lineage, profiling, layout, access and audit operators.

Every operator takes DataFrames (or Columns) and returns DataFrames (or Columns); nothing runs until the
caller acts on the result, except the few iterative graph walks that write each frontier to the shared
checkpoint folder.
"""

__version__ = "0.1.0"
