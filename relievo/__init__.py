"""relievo: planetary raster and terrain analytics on Spark DataFrames."""
