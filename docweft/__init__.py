"""docweft: event-graph analytics and document processing on Spark DataFrames."""
