"""Vector-tile and GeoJSON analytics on Spark DataFrames."""
