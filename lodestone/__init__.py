"""lodestone: a PySpark-native hybrid retrieval and retrieval-evaluation engine."""
