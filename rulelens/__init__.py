"""rulelens: evidence retrieval and decision analytics over numbered-clause corpora, on Spark."""
