"""cleaveset: score, rank and partition datasets with Spark DataFrames."""
