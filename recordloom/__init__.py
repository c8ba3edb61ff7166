"""Health-record analytics on PySpark: every operator takes and returns DataFrames."""
