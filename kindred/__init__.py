"""kindred: Spark jobs for building, comparing and evaluating a retrieval corpus."""
