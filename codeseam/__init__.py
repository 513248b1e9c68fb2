"""Code-facts analytics on Spark: relational operators over source-tree facts and any node/edge/document table."""
