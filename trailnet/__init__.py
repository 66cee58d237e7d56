"""trailnet: trail-network analytics on PySpark DataFrames."""
