"""loomgraph: a PySpark-native analytics engine for text-attributed graphs."""
