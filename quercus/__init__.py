"""quercus: a PySpark-native analytics engine for research-output data."""
