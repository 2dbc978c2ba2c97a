"""Column builders: text, vectors and scores. No UDFs."""
