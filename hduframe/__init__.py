"""FITS catalogues and arrays, and relational tables, as Spark DataFrames."""
