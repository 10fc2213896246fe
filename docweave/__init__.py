"""docweave: corpus analytics for marked-up documents on Spark DataFrames."""
