"""HTML documents to Markdown on Spark."""
