"""SAR raster analytics on Spark DataFrames."""
