"""tidemark: declarative incremental loads on Spark."""
