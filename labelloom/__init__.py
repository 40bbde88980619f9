"""Evidence-bound document structuring and consistency checking on Spark DataFrames."""
