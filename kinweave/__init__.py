"""kinweave: record linkage, family-graph alignment and corpus preparation on PySpark DataFrames."""
