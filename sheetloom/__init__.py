"""sheetloom: structuring, profiling and checking of messy tables on Spark.

Tables arrive as row-addressed grids, many at a time, each keyed by
``table_id``; documents arrive as JSON text or VARIANT keyed by ``doc_id``.
Every operator maps DataFrames to DataFrames or Columns to Columns.
"""
