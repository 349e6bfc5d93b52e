"""Evidence and corpus analytics expressed as Spark DataFrames."""
