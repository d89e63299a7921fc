"""quillgraph: literature-graph analytics expressed as Spark DataFrame, SQL and Structured Streaming plans."""
