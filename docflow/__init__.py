"""docflow: ordered document processing and analytics on Spark DataFrames."""
